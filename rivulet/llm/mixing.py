"""Mixing sources to target weights with exact budgets, in DataFrame operations only.

Each document gets a hash-random key.  A source's documents are dealt to ranges by the key's
leading digits, which sorts the ranges; each begins at the prefix sum of the ranges before it, so
the range in which the budget ends is known from one sum a range.  Only that range is divided
again, until it has at most ``range_rows`` documents, which are sorted; the key at which the budget
ends is the source's cut.  A source's mix is as many whole epochs as its budget holds, then the
documents before the cut, and the one at the cut with the words that still fit.

What is shuffled are sums for each range and the documents of the cut's ranges, without their
texts.  The decision is then a comparison with one row for each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.runtime import Rows, checkpointed, few

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources up to which tables with a row for each source are broadcast.
FEW_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """Production parameters: repeating weights, cap in epochs, seed, hex digits by which a range
    is divided, and the rows up to which it is sorted instead."""

    weights: tuple[int, ...] = (5, 2, 1)
    epochs: int = 3
    seed: str = "mix-1"
    digits: int = 3
    range_rows: int = 100_000


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target, budget) of a table (source, source_size).

    Targets share the sum of all sizes by weight.  A source stops at ``epochs`` times its size and
    what it can't take is shared again, which has a closed form: with sources sorted by cap over
    weight, those before the first one that can take its share are at their caps.  The windows
    run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(x).cast("double") for x in mix.weights)), ((F.row_number().over(by_name) - 1) % len(mix.weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(mix.epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(after)).withColumn("i", F.row_number().over(order))
    s = s.withColumn("first", F.min(F.when(F.col("left") * F.col("w") <= F.col("cap") * F.col("open"), F.struct("i", "left", "open"))).over(everything))
    share = F.col("w") * F.col("first.left") / F.col("first.open")
    s = s.withColumn("target", F.when(F.col("first").isNull() | (F.col("i") < F.col("first.i")), F.col("cap")).otherwise(F.least("cap", share)))
    return s.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def _key(doc_id: Column, text: Column, mix: Mix) -> Column:
    """32 hex digits; rows without an id differ by their text."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), doc_id.cast("string"), F.md5(text)))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _with(rows: DataFrame, side: DataFrame, source: str = "source") -> DataFrame:
    """Join a row for each source, null being one."""
    side = few(side.withColumnRenamed("source", "_by"), FEW_SOURCES)
    return rows.join(side, F.col(source).eqNullSafe(F.col("_by"))).drop("_by")


def cuts(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target, whole, cut, share) of a table (source, key, size).

    A row is taken ``whole`` times, once more if its key is before the cut, and with ``share``
    more words if it is at the cut.  Rows of one key share what is left there equally.
    """
    sums = checkpointed(sized.groupBy("source", F.substring("key", 1, mix.digits).alias("range")).agg(F.sum("size").alias("part"), F.count("*").alias("n")))
    plan = targets(sums.groupBy("source").agg(F.sum("part").alias("source_size")), mix)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.nullif("source_size", F.lit(0)))).otherwise(0).cast("long")
    plan = checkpointed(plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size")))
    digits, rest = mix.digits, plan.filter("rest > 0").select("source", "rest")
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        placed = _with(sums, rest).withColumn("start", F.coalesce(F.sum("part").over(in_order), F.lit(0)))
        cut = placed.filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("part") >= F.col("rest")))
        cut = checkpointed(cut.select("source", "range", (F.col("rest") - F.col("start")).alias("rest"), "n"))
        inside = _with(sized, cut.withColumnRenamed("range", "of")).filter(F.substring("key", 1, digits) == F.col("of"))
        if digits >= 32 or cut.filter(F.col("n") > mix.range_rows).isEmpty():
            break
        digits = min(32, digits + mix.digits)
        sums = inside.groupBy("source", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("part"), F.count("*").alias("n"))
        rest = cut.select("source", "rest")
    by_key = inside.groupBy("source", "key", "rest").agg(F.sum("size").alias("part"), F.count("*").alias("n"))
    start = F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = by_key.withColumn("start", start).filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("part") >= F.col("rest")))
    ends = ends.select(F.col("source").alias("_s"), F.col("key").alias("cut"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).cast("long").alias("share"))
    found = plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
    return checkpointed(found.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("share", F.lit(0)).alias("share")))


def _taken(key: Column, size: Column) -> Column:
    more = F.when(key < F.col("cut"), size).when(key == F.col("cut"), F.col("share")).otherwise(0)
    return (F.col("whole") * size + more).cast("long")


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    A null or empty text has size 0 and a long one all its words; a null source is a source of
    its own, the last; sources without words have target 0; rows of equal doc_id and text take
    equal numbers of words, so where such rows meet the cut fewer words than there are rows may
    stay untaken; no rows give no rows.  Extra columns are ignored, whatever their names.
    """
    rows = Rows(docs).select("doc_id", "text", "source")
    rows = checkpointed(rows.select("doc_id", "source", _key(F.col("doc_id"), F.col("text"), mix).alias("key"), _size(F.col("text")).alias("size")))
    out = _with(rows, cuts(rows.select("source", "key", "size"), mix))
    return out.select("doc_id", "size", "source_size", "target", _taken(F.col("key"), F.col("size")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, and size, source_size, target
    and taken: the words to train on, repeats counted.

    Cases are as for mixture(); a column of docs of one of these four names is kept with an
    underscore at its end.
    """
    rows = Rows(docs)
    key, size = _key(rows.column("doc_id"), rows.column("text"), mix), _size(rows.column("text"))
    sized = checkpointed(rows.frame.select(rows.column("source").alias("source"), key.alias("key"), size.alias("size")))
    out = _with(rows.frame.select("row", rows.column("source").alias("source"), key.alias("key"), size.alias("size")), cuts(sized, mix))
    out = out.withColumn("taken", _taken(F.col("key"), F.col("size"))).filter("taken > 0")
    return rows.unpacked(out, **{c: F.col(c) for c in ("size", "source_size", "target", "taken")})


#: The contract and this module's order in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', 'mix-1', doc_id::VARCHAR, md5(text))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 3.0::DOUBLE AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER t AS i, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s WINDOW t AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT i AS fi, rest AS fr, open AS fo FROM o WHERE rest * w <= cap * open ORDER BY i LIMIT 1),
p AS (SELECT source, source_size, CASE WHEN fi IS NULL OR i < fi THEN cap ELSE least(cap, w * fr / fo) END AS target FROM o LEFT JOIN f ON true),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM p),
k AS (SELECT source, key, sum(size)::BIGINT AS part, count(*) AS n FROM d GROUP BY source, key),
x AS (SELECT k.source, key, part, n, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS rest, coalesce(sum(part) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN rest <= start THEN 0 WHEN start + part >= rest THEN (rest - start) // n ELSE size END)::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.key = x.key
"""
