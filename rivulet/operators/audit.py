"""Audits of raw partitions: per file and column, and quality after quarantine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.contract import REGISTERED
from rivulet.functions import scalar as S
from rivulet.operators.normalize import issues
from rivulet.operators.quality import eligible

MEASURES = ("rows", "native_missing", "sentinel_missing", "invalid", "negative", "non_integral", "out_of_port_range", "bad_label", "bad_boolean")


def _cells(df: DataFrame, columns: Iterable[str], by: list[str]) -> DataFrame:
    """(by, column, flags) with a row for each cell, from one scan."""
    kinds, cells = dict(df.dtypes), []
    for c in columns:
        raw, spec = F.col(f"`{c}`"), REGISTERED.get(c)
        gone = S.missing(raw)
        null = raw.isNull() | F.isnan(raw) if kinds[c] in ("double", "float") else raw.isNull()
        x = S.number(raw, kinds[c])
        yes = lambda test: F.coalesce(test & ~gone, F.lit(False)).cast("int")  # noqa: E731, B023
        numeric = bool(spec and spec.numeric) or (not spec and kinds[c] != "string")
        no = F.lit(0)
        flags = {
            "native_missing": null.cast("int"),
            "sentinel_missing": (gone & ~null).cast("int"),
            "invalid": yes(x.isNull()) if numeric else no,
            "negative": yes(x < 0) if numeric else no,
            "non_integral": yes(x % 1 != 0) if numeric and (not spec or spec.integral) else no,
            "out_of_port_range": yes((x < 0) | (x > 65535)) if spec and spec.kind == "port" else no,
            "bad_label": yes(x.isNull() | ~x.isin(0.0, 1.0)) if spec and spec.kind == "binary_target" else no,
            "bad_boolean": yes(S.truth(raw).isNull()) if spec and spec.kind == "boolean" else no,
        }
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), *(v.alias(k) for k, v in flags.items())))
    return df.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")


def by_column(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Counts of every measure for each column, and for each file if by names it."""
    by = list(by)
    sums = [F.count("*").alias("rows")] + [F.sum(m).cast("bigint").alias(m) for m in MEASURES[1:]]
    return _cells(df, columns, by).groupBy(*by, "column", "dtype").agg(*sums)


def with_total(df: DataFrame, columns: Iterable[str], file: str) -> DataFrame:
    """by_column for each file and, as file ALL, over all of them."""
    sums = [F.count("*").alias("rows")] + [F.sum(m).cast("bigint").alias(m) for m in MEASURES[1:]]
    rolled = _cells(df, columns, [file]).rollup("column", file).agg(*sums)
    return rolled.filter("column is not null").withColumn(file, F.coalesce(F.col(file).cast("string"), F.lit("ALL")))


def quality(df: DataFrame, file: str, position: str, n: int = 5) -> tuple[DataFrame, dict]:
    """Violations left after quarantine: a table (file, column, issue, count) and first examples.

    Counts are conditional sums of one scan.  If there are violations, a second scan turns the bad
    cells alone into rows and ranks them; tasks keep the first n of each kind before the shuffle.
    The dict says whether the population is compatible, which decides a command's exit code.
    """
    kept, kinds = eligible(df), dict(df.dtypes)
    checks = [(c, k, x) for c in df.columns if c in REGISTERED for k, x in issues(c, kinds[c], REGISTERED[c]).items()]
    wide = kept.groupBy(file).agg(*(F.count_if(x).alias(f"{i}") for i, (_, _, x) in enumerate(checks)))
    long = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("issue"), F.col(f"`{i}`").alias("count")) for i, (c, k, _) in enumerate(checks)))
    table = wide.select(file, F.explode(long).alias("x")).select(file, "x.*")
    counts: dict[str, int] = {}
    for r in table.groupBy("column", "issue").agg(F.sum("count").alias("count")).filter(F.col("count") > 0).collect():
        counts[f"{r.column}:{r.issue}"] = r["count"]
    found = {k: {"count": m, "examples": []} for k, m in counts.items()}
    if found:
        shown = lambda c: F.substring(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")), 1, 80)
        cells = [F.when(x, F.struct(F.lit(f"{c}:{k}").alias("key"), shown(c).alias("value"))) for c, k, x in checks if f"{c}:{k}" in counts]
        bad = kept.select(F.col(position).cast("bigint").alias("position"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("position", "x.*")
        rank = F.row_number().over(Window.partitionBy("key").orderBy("position"))
        for r in bad.withColumn("rank", rank).filter(F.col("rank") <= n).orderBy("key", "rank").collect():
            found[r.key]["examples"].append({"position": r.position, "value": r.value})
    return table, {"compatible": not found, "violations": found, "exit_code": int(bool(found))}
