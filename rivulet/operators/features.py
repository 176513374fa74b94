"""Feature policies, causal time features, and the leakage guard."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.contract import DATASET_IDS, FLOW, IDENTITY, IPS, PORTS, ROW_IDS, SERVICES, TARGETS
from rivulet.functions import scalar as S
from rivulet.operators.normalize import with_time
from rivulet.sources.sinks import write_json

POLICIES = ("all_except_labels", "no_raw_ip", "no_raw_ip_port", "behavioral_strict")
# The strict policy's version and ordered features.
STRICT_VERSION = "behavioral_strict/2.0.0"
STRICT = ("duration", "src_bytes", "dst_bytes", "conn_state", "missed_bytes", "src_pkts", "src_ip_bytes", "dst_pkts", "dst_ip_bytes")


class LeakageError(ValueError):
    """A forbidden column is among the features."""


def _lower(names: Iterable[str]) -> set[str]:
    return {n.strip().lower() for n in names if n}


def _known(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown feature policy {policy!r}; one of {', '.join(POLICIES)}")


def select(df: DataFrame, policy: str, label: str = "label", kind: str = "type", more_targets: Iterable[str] = ()) -> list[str]:
    """The features, in table order or, for the strict policy, in its own.

    The policies remove targets and dataset ids, then addresses and row ids, then ports; the
    strict policy is a closed list that must be there whole.
    """
    _known(policy)
    targets = _lower(TARGETS | {label, kind} | set(more_targets))
    if policy == "behavioral_strict":
        if len(set(df.columns)) < len(df.columns):
            raise ValueError(f"{STRICT_VERSION}: repeated column names")
        if lost := [c for c in STRICT if c not in df.columns]:
            raise ValueError(f"{STRICT_VERSION}: missing features {lost}")
        if clash := [c for c in STRICT if c in targets]:
            raise ValueError(f"{STRICT_VERSION}: targets among the features {clash}")
        return list(STRICT)
    gone = targets | _lower(DATASET_IDS)
    if policy != "all_except_labels":
        gone |= _lower(IPS | ROW_IDS)
    if policy == "no_raw_ip_port":
        gone |= _lower(PORTS)
    return [c for c in df.columns if c.strip().lower() not in gone and not c.startswith("_")]


def metadata(policy: str, found: Iterable[str]) -> dict:
    found = list(found)
    return {"feature_policy": policy, "feature_policy_version": STRICT_VERSION if policy == "behavioral_strict" else None, "requested_features": list(STRICT) if policy == "behavioral_strict" else found, "found_features": found, "semantic_types": {c: FLOW[c].kind for c in found if c in FLOW}}


def forbidden(policy: str, label: str = "label", kind: str = "type") -> set[str]:
    """What must not reach a model; for ports this is wider than what select() removes."""
    _known(policy)
    out = _lower(TARGETS | DATASET_IDS | {label, kind})
    if policy == "no_raw_ip":
        out |= _lower(IPS | ROW_IDS)
    if policy in ("no_raw_ip_port", "behavioral_strict"):
        out |= _lower(IDENTITY)
    if policy == "behavioral_strict":
        out |= _lower(SERVICES)
    return out


def guard(features: Iterable[str], policy: str, label: str = "label", kind: str = "type", stage: str = "", path: str | Path | None = None) -> dict:
    """Raise LeakageError on a forbidden feature, after writing the check if there is a path.

    Called before every fit.  The strict policy also asks for its exact features and order.
    """
    features = list(features)
    hit = [c for c in features if c.strip().lower() in forbidden(policy, label, kind)]
    order = policy != "behavioral_strict" or features == list(STRICT)
    out = {"stage": stage, "feature_policy": policy, "features": features, "forbidden_found": hit, "order_ok": order, "ok": not hit and order}
    if path:
        write_json(path, out)
    if not out["ok"]:
        raise LeakageError(f"{stage or 'features'}: forbidden {hit}" if hit else f"{stage or 'features'}: not the policy's features in order")
    return out


def time_features(df: DataFrame, features: list[str], column: str, policy: str = "keep", unit: str = "auto") -> tuple[DataFrame, list[str]]:
    """keep, drop, or replace a selected timestamp by its UTC hour and weekday (-1 if missing).

    Epoch numbers are read in their unit, given or inferred.
    """
    if policy not in ("keep", "drop", "extract_causal"):
        raise ValueError(f"unknown timestamp policy {policy!r}")
    if policy == "keep" or column not in features:
        return df, features
    rest = [c for c in features if c != column]
    if policy == "drop":
        return df, rest
    hour, day = f"{column}_hour", f"{column}_day_of_week"
    timed = with_time(df, column, unit, "_causal")
    return timed.withColumn(hour, S.hour_of(F.col("_causal"))).withColumn(day, S.weekday_of(F.col("_causal"))).drop("_causal"), [*rest, hour, day]


def service_features(features: list[str], policy: str = "keep") -> list[str]:
    if policy not in ("keep", "drop"):
        raise ValueError(f"unknown service policy {policy!r}")
    return features if policy == "keep" else [c for c in features if c.lower() not in SERVICES]
