"""Strict schema normalisation: one select, and one pass that counts every violation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.contract import FLOW, REGISTERED, SCHEMA_VERSION, Spec
from rivulet.functions import scalar as S
from rivulet.sources.sinks import write_json

ISSUES = ("missing_required", "conversion_failure", "infinite", "domain_violation", "unsafe_integer_precision")
#: Columns whose aggregates go into one job, so that generated code stays within its limits.
WIDTH = 16
EXAMPLES = 5


class SchemaError(ValueError):
    """Some cells violate the contract; ``report`` says which."""

    def __init__(self, report: dict):
        bad = [c for c, x in report["columns"].items() if x["invalid_count"]]
        super().__init__(f"schema violations in {', '.join(bad)}")
        self.report = report


def issues(name: str, kind: str, spec: Spec) -> dict[str, Column]:
    """The checks of a raw column of a Spark type, as booleans that are never null."""
    c = F.col(f"`{name}`")
    gone, out = S.missing(c), {}
    if kind in ("double", "float"):
        gone = gone | F.isnan(c)
    if not spec.nullable:
        out["missing_required"] = gone
    if spec.numeric:
        x = S.number(c, kind)
        out["conversion_failure"] = ~gone & x.isNull()
        out["infinite"] = S.infinite(x) & ~gone
        out["domain_violation"] = S.outside(x, spec) & ~gone
        if spec.integral:
            out["unsafe_integer_precision"] = S.imprecise(x) & ~gone
    elif spec.kind == "boolean":
        out["domain_violation"] = ~gone & S.truth(c).isNull()
    return out


def normalised(name: str, kind: str, spec: Spec) -> Column:
    """The canonical value; invalid cells become null here and are counted elsewhere."""
    c = F.col(f"`{name}`")
    gone = S.missing(c)
    if spec.numeric:
        x = S.number(c, kind)
        bad = reduce(or_, issues(name, kind, spec).values())
        x = F.when(~bad & ~gone, x)
        value = S.code(x) if spec.kind == "nominal_code" else x.cast(spec.storage)
    else:
        value = F.when(~gone, S.truth(c) if spec.kind == "boolean" else c.cast("string"))
    return value.alias(name, metadata={"kind": spec.kind, "treatment": spec.treatment})


def project(df: DataFrame) -> DataFrame:
    """df with every registered column normalised; others and the column order stay."""
    kinds = dict(df.dtypes)
    return df.select(*(normalised(c, kinds[c], REGISTERED[c]) if c in REGISTERED else F.col(f"`{c}`") for c in df.columns))


def column_report(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, dict]:
    """For each registered column: missing cells by kind, violations, missing cells afterwards.

    One job for each WIDTH columns; the driver gets counts only.
    """
    kinds, out = dict(df.dtypes), {}
    wanted = [c for c in columns or df.columns if c in REGISTERED]
    for lo in range(0, len(wanted), WIDTH):
        part, aggs = wanted[lo : lo + WIDTH], []
        for i, c in enumerate(part):
            own, raw, spec = issues(c, kinds[c], REGISTERED[c]), F.col(f"`{c}`"), REGISTERED[c]
            null = raw.isNull() | F.isnan(raw) if kinds[c] in ("double", "float") else raw.isNull()
            aggs += [F.count_if(null).alias(f"{i}:null"), F.count_if(S.missing(raw) & ~null).alias(f"{i}:token"), F.count_if(normalised(c, kinds[c], spec).isNull()).alias(f"{i}:after")]
            aggs += [F.count_if(x).alias(f"{i}:{k}") for k, x in own.items()] + [F.count_if(reduce(or_, own.values()) if own else F.lit(False)).alias(f"{i}:bad")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            spec = REGISTERED[c]
            out[c] = {"kind": spec.kind, "source_dtype": kinds[c], "normalized_dtype": spec.spark_type().simpleString(), "native_missing_count": row[f"{i}:null"], "sentinel_missing_count": row[f"{i}:token"], "missing_after": row[f"{i}:after"], "invalid_count": row[f"{i}:bad"], "issues": {k: {"count": row[f"{i}:{k}"], "examples": []} for k in issues(c, kinds[c], spec)}}
    return out


def examples(df: DataFrame, column: str, issue: str, position: str, n: int = EXAMPLES) -> DataFrame:
    """(position, value): the first n violating rows; a top-n with partial tops in each task."""
    bad = issues(column, dict(df.dtypes)[column], REGISTERED[column])[issue]
    return df.filter(bad).select(F.col(position).cast("bigint").alias("position"), F.substring(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null")), 1, 80).alias("value")).orderBy("position").limit(n)


def normalize(df: DataFrame, report_path: str | Path | None = None, position: str | None = None) -> tuple[DataFrame, dict]:
    """The normalised table and its report; SchemaError, after writing the report, if a cell is invalid.

    With a position column the report holds each violation's first rows.
    """
    found = {"schema_version": SCHEMA_VERSION, "unknown_columns": [c for c in df.columns if c not in REGISTERED and not c.startswith("_")], "absent_columns": [c for c in FLOW if c not in df.columns], "columns": column_report(df)}
    for c, info in found["columns"].items():
        for issue, x in info["issues"].items():
            if x["count"] and position:
                x["examples"] = [r.asDict() for r in examples(df, c, issue, position).collect()]
    found["ok"] = not any(x["invalid_count"] for x in found["columns"].values())
    if report_path:
        write_json(report_path, found)
    if not found["ok"]:
        raise SchemaError(found)
    return project(df), found


def feature_kinds(df: DataFrame, features: Iterable[str], strict: bool = False) -> tuple[list[str], list[str]]:
    """Numeric and categorical features, by contract or else by type.

    A target is no feature; with strict an unregistered column isn't either.
    """
    kinds, numeric, nominal = {f.name: f.dataType for f in df.schema}, [], []
    for c in features:
        spec = REGISTERED.get(c)
        if spec and spec.treatment == "target":
            raise ValueError(f"target {c!r} can't be a feature")
        if not spec and strict:
            raise ValueError(f"unregistered feature {c!r}")
        as_number = spec.treatment == "numeric" if spec else isinstance(kinds[c], T.NumericType)
        (numeric if as_number else nominal).append(c)
    return numeric, nominal


def log_columns(features: Iterable[str], wanted: Iterable[str] | None = None) -> list[str]:
    """The features that get log1p: those of the contract, or an explicit list within it."""
    registered = {c for c, s in FLOW.items() if s.log1p}
    if wanted is not None and (extra := set(wanted) - registered):
        raise ValueError(f"log1p isn't registered for {sorted(extra)}")
    chosen = registered if wanted is None else set(wanted)
    return [c for c in features if c in chosen]


def apply_log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(1 + x) in place; ValueError if a value is negative or infinite, nulls pass."""
    if not columns:
        return df
    bad = df.agg(*(F.count_if((F.col(c) < 0) | S.infinite(F.col(c).cast("double"))).alias(c) for c in columns)).first().asDict()
    if any(bad.values()):
        raise ValueError(f"log1p of negative or infinite values: { {c: n for c, n in bad.items() if n} }")
    return df.withColumns({c: S.log1p(F.col(c)) for c in columns})


def infer_unit(df: DataFrame, column: str) -> str | None:
    x = S.number(F.col(column), dict(df.dtypes)[column])
    row = df.agg(F.avg(x.isNotNull().cast("double")).alias("share"), F.percentile(F.abs(x), F.lit(0.5)).alias("median")).first()
    return S.unit_of(row["share"], row["median"])


def with_time(df: DataFrame, column: str, unit: str = "auto", name: str = "_ts") -> DataFrame:
    """A UTC timestamp column from a timestamp, epoch numbers or text; invalid values are null."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        return df.withColumn(name, F.col(column).cast("timestamp"))
    found = infer_unit(df, column) if unit == "auto" else unit
    if found:
        return df.withColumn(name, S.timestamp(F.col(column), found))
    return df.withColumn(name, F.try_to_timestamp(F.col(column).cast("string")))
