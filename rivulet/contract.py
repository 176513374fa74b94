"""The semantic schema contract of network-flow tables.

Storage, meaning and model treatment of a column are separate.  ``FLOW`` lists the columns of a
flow table in order; a file belongs to it if its header has the signature columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

MISSING = ("", "-")
MAX_EXACT = 2**53 - 1
#: Seconds whose nanoseconds don't fit a 64-bit integer.
MAX_SECONDS = (2**63 - 1) / 1e9


@dataclass(frozen=True)
class Spec:
    """What a column means and which values it may have."""

    kind: str
    storage: str = "string"
    treatment: str = "categorical"
    low: float | None = None
    high: float | None = None
    integral: bool = False
    nullable: bool = True
    log1p: bool = False

    @property
    def numeric(self) -> bool:
        return self.storage in ("double", "bigint") or self.kind == "nominal_code"

    def spark_type(self) -> T.DataType:
        return {"double": T.DoubleType(), "bigint": T.LongType()}.get(self.storage, T.StringType())


_KINDS = {
    "timestamp": Spec("timestamp", "double", "numeric", low=0),
    "identifier": Spec("identifier"),
    "port": Spec("port", "bigint", "categorical", low=0, high=65535, integral=True),
    "nominal": Spec("nominal"),
    "continuous": Spec("continuous", "double", "numeric", low=0, log1p=True),
    "count": Spec("count", "double", "numeric", low=0, integral=True, log1p=True),
    "nominal_code": Spec("nominal_code", low=0, integral=True),
    "boolean": Spec("boolean"),
    "text": Spec("text"),
    "binary_target": Spec("binary_target", "bigint", "target", low=0, high=1, integral=True, nullable=False),
    "multiclass_target": Spec("multiclass_target", "string", "target", nullable=False),
    "hour": Spec("calendar_component", "bigint", "numeric", low=-1, high=23, integral=True),
    "weekday": Spec("calendar_component", "bigint", "numeric", low=-1, high=6, integral=True),
}

# The columns of a flow table, in order, with their kinds.
_COLUMNS = """
ts timestamp
uid identifier
src_ip identifier
src_port port
dst_ip identifier
dst_port port
proto nominal
service nominal
duration continuous
src_bytes count
dst_bytes count
conn_state nominal
missed_bytes count
src_pkts count
src_ip_bytes count
dst_pkts count
dst_ip_bytes count
dns_query text
dns_qclass nominal_code
dns_qtype nominal_code
dns_rcode nominal_code
dns_AA boolean
dns_RD boolean
dns_RA boolean
dns_rejected boolean
ssl_version nominal
ssl_cipher nominal
ssl_resumed boolean
ssl_established boolean
ssl_subject text
ssl_issuer text
http_trans_depth count
http_method nominal
http_uri text
http_referrer text
http_version nominal
http_request_body_len count
http_response_body_len count
http_status_code nominal_code
http_user_agent text
http_orig_mime_types text
http_resp_mime_types text
weird_name nominal
weird_addl text
weird_notice boolean
label binary_target
type multiclass_target
"""
FLOW: dict[str, Spec] = {name: _KINDS[kind] for name, kind in (x.split() for x in _COLUMNS.strip().splitlines())}
DERIVED: dict[str, Spec] = {"ts_hour": _KINDS["hour"], "ts_day_of_week": _KINDS["weekday"]}
REGISTERED = FLOW | DERIVED
LOG1P = tuple(c for c, s in FLOW.items() if s.log1p)

# The contract's identity, the signature, and names with a role.
SCHEMA_VERSION = "ton_iot_network/1.0.0"
SIGNATURE = ("ts", "src_ip", "dst_ip", "src_bytes", "dns_qtype")
TARGETS = frozenset("label type target attack_cat class cluster_id".split())
IPS = frozenset("src_ip dst_ip srcip dstip ip_src ip_dst".split())
PORTS = frozenset("src_port dst_port sport dport source_port destination_port".split())
ROW_IDS = frozenset("uid flow_id id".split())
IDENTITY = IPS | PORTS | ROW_IDS
DATASET_IDS = frozenset("dataset_id source_dataset".split())
SERVICES = frozenset("service svc application app proto_service".split())
#: Accepted spellings of booleans.
BOOLEANS = {"T": "T", "F": "F", "true": "T", "false": "F", "True": "T", "False": "F", "TRUE": "T", "FALSE": "F", "1": "T", "0": "F", "1.0": "T", "0.0": "F"}


def recognised(columns: Iterable[str]) -> bool:
    return set(SIGNATURE) <= set(columns)


def schema(columns: Iterable[str]) -> T.StructType:
    """The normalised types of these columns, with their meaning as metadata."""
    fields = []
    for c in columns:
        spec = REGISTERED.get(c)
        fields.append(T.StructField(c, spec.spark_type() if spec else T.StringType(), not spec or spec.nullable, {"kind": spec.kind, "treatment": spec.treatment} if spec else {}))
    return T.StructType(fields)
