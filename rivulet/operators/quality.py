"""Population eligibility: quarantine of the known corruption, and population identity."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.contract import SCHEMA_VERSION
from rivulet.functions.digests import canonical, digest
from rivulet.sources.readers import FILE_NO, FILE_ROW, SOURCE_ID
from rivulet.sources.sinks import write_json

# The rule and its identity.
POLICY_VERSION = "ton_iot_known_corruption/1.0.0"
RULE_ID = "quarantine_src_bytes_ipv4_literal"
BAD_TOKEN = "0.0.0.0"
IDENTITY_FORMAT = "source-content-and-membership/1"


def corrupt(df: DataFrame, column: str = "src_bytes") -> Column:
    """The exact token; null and columns that aren't strings never match."""
    if sum(c == column for c in df.columns) != 1:
        raise ValueError(f"{column} must occur once")
    if dict(df.dtypes)[column] != "string":
        return F.lit(False)
    return F.coalesce(F.col(column) == BAD_TOKEN, F.lit(False))


def eligible(df: DataFrame) -> DataFrame:
    return df.filter(~corrupt(df))


def counts(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """original_rows, quarantined_rows, eligible_rows in one pass."""
    bad = corrupt(df)
    return df.groupBy(*by).agg(F.count("*").alias("original_rows"), F.count_if(bad).alias("quarantined_rows"), F.count_if(~bad).alias("eligible_rows"))


def positions(df: DataFrame) -> DataFrame:
    """(file, row) of the quarantined rows; only these can be collected."""
    return df.filter(corrupt(df)).select(FILE_NO, SOURCE_ID, FILE_ROW)


def target_counts(df: DataFrame, targets: Iterable[str] = ("label", "type"), by: Iterable[str] = ()) -> DataFrame:
    """(by, target, value, count) over eligible rows; a null value counts native nulls."""
    kept = eligible(df) if "src_bytes" in df.columns else df
    by = list(by)
    long = kept.select(*by, F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("value")) for t in targets))).alias("x"))
    return long.groupBy(*by, "x.target", "x.value").agg(F.count("*").alias("count"))


def report(df: DataFrame, fingerprints: dict[str, str]) -> dict:
    """The population report of a table from load_raw(); fingerprints: SHA-256 by source id.

    Collected are a row for each file, the quarantined positions and the target counts.
    """
    by_file = {r[SOURCE_ID]: r for r in counts(df, [FILE_NO, SOURCE_ID]).orderBy(FILE_NO).collect()}
    places: dict[str, list[int]] = {s: [] for s in by_file}
    for r in positions(df).orderBy(FILE_NO, FILE_ROW).toLocalIterator():
        places[r[SOURCE_ID]].append(r[FILE_ROW])
    files = [{"source_id": s, "source_sha256": fingerprints[s], "original_rows": r.original_rows, "quarantined_row_positions_0based": places[s]} for s, r in by_file.items()]
    identity = {"format": IDENTITY_FORMAT, "policy_version": POLICY_VERSION, "schema_version": SCHEMA_VERSION, "rule_id": RULE_ID, "files": files}
    targets: dict[str, dict] = {}
    present = [t for t in ("label", "type") if t in df.columns]
    for r in (target_counts(df, present).orderBy("target", "value").collect() if present else []):
        own = targets.setdefault(r.target, {"values": {}, "native_nulls": 0})
        if r.value is None:
            own["native_nulls"] = r["count"]
        else:
            own["values"][r.value] = r["count"]
    total = lambda f: sum(r[f] for r in by_file.values())
    return {"policy_version": POLICY_VERSION, "schema_version": SCHEMA_VERSION, "population_id": digest(identity), "population_identity_manifest": identity, "rule": {"id": RULE_ID, "column": "src_bytes", "operator": "exact_literal_equality", "value": BAD_TOKEN, "action": "quarantine"}, "original_rows": total("original_rows"), "quarantined_rows": total("quarantined_rows"), "eligible_rows": total("eligible_rows"), "eligible_target_distributions": targets}


def save(found: dict, path: str | Path | None = None) -> Path:
    return write_json(path or Path("artifacts/data_quality") / (found["population_id"].split(":", 1)[1] + ".json"), found)


def verify(found: dict, frozen: dict) -> None:
    """ValueError unless order, content and membership are those of a frozen report."""
    a, b = found["population_identity_manifest"], frozen["population_identity_manifest"]
    if [f["source_id"] for f in a["files"]] != [f["source_id"] for f in b["files"]]:
        raise ValueError("source order or set differs from the frozen population")
    if canonical(a) != canonical(b):
        raise ValueError("source content or membership differs from the frozen population")


def partitions(names: Iterable[str], n: int) -> dict:
    """Which of the files numbered 1 to n are missing, extra or repeated."""
    import re

    own = [int(m[1]) for x in names if (m := re.search(r"_(\d+)\.(?:csv|parquet)$", x))]
    return {"missing": sorted(set(range(1, n + 1)) - set(own)), "extra": sorted(set(own) - set(range(1, n + 1))), "repeated": sorted({x for x in own if own.count(x) > 1}), "ok": sorted(own) == list(range(1, n + 1))}
