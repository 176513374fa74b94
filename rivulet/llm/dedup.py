"""MinHash near-duplicates with tensored banding and exact verification.

A banding index with L tables of 2r minhashes each needs 2rL minhash values.  Here two
collections of m half-keys, of r values each, are made; the L = m*m table keys are all pairs of a
half-key of the first and one of the second collection, so only 2rm values are computed.  Two
documents of similarity s share a table with probability (1 - (1 - s^r)^m)^2.

Documents with equal shingle sets form a class and only its representative is compared.  In large
buckets members are first checked against some pivots, which joins most of them; then all pairs of
a bucket that are still in different components are checked, in blocks if they are many, so no
link that a table holds and that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import textkernel as tk
from rivulet.llm.graph import components
from rivulet.llm.runtime import Rows, checkpointed, columns, few, texts, tune, written

U64 = np.uint64


@dataclass(frozen=True)
class Banding:
    """Production parameters: shingle length, threshold in percent, r, m."""

    words: int = 2
    percent: int = 80
    rows: int = 3
    halves: int = 9
    #: Rounds of pivots, the part of the buckets in each, pairs for each row of a bucket that may
    #: become rows, and shingles in a block otherwise.
    pivot_rounds: int = 1
    pivot_share: int = 9
    pairs_a_row: float = 1.0
    block_shingles: int = 400_000
    #: Up to so many candidate documents their ids are broadcast (8 bytes each) to pick the texts.
    broadcast_ids: int = 1 << 20


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, n), dtype=np.int64).astype(U64) | U64(1)


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One value for each hash function, over all shingles of a set."""
    out = np.full(factors.shape[1], 0xFFFFFFFFFFFFFFFF, U64)
    for lo in range(0, len(shingles), 4096):
        part = (shingles[lo : lo + 4096, None] ^ factors[0]) * factors[1]
        np.minimum(out, part.min(axis=0), out=out)
    return out


def half_keys(shingles: np.ndarray, factors: np.ndarray, band: Banding) -> np.ndarray:
    """The m half-keys of the first collection and then the m of the second."""
    parts = minhashes(shingles, factors).reshape(2 * band.halves, band.rows)
    half = np.zeros(2 * band.halves, U64)
    for j in range(band.rows):
        half = tk.mix(half + parts[:, j])
    return half


_SETS = "doc_id long, n_shingles long, set1 long, set2 long, halves array<long>"


def _sets(docs: DataFrame, band: Banding) -> DataFrame:
    """(doc_id, n_shingles, set1, set2, halves): the set's size, a 128-bit digest, its half-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(2 * band.halves * band.rows)
        for batch in batches:
            sets = [tk.shingle_set(tk.word_hashes(tk.LOWER[t]), band.words) for t in texts(batch.column("text"))]
            with np.errstate(over="ignore"):
                one = np.array([s.sum(dtype=U64) for s in sets], U64).view(np.int64)
                two = np.array([tk.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64).view(np.int64)
            halves = pa.array([half_keys(s, factors, band).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), halves], ["doc_id", "n_shingles", "set1", "set2", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, _SETS)


def table_keys(classes: DataFrame, band: Banding) -> DataFrame:
    """(key, id, n): the m*m table keys of each class, pairs of its half-keys, and its set's size."""
    first = classes.select("id", F.col("n_shingles").alias("n"), F.posexplode(F.slice("halves", 1, band.halves)).alias("i", "x"), F.slice("halves", band.halves + 1, band.halves).alias("second"))
    return first.select("id", "n", "i", "x", F.posexplode("second").alias("j", "y")).select(F.xxhash64("i", "j", "x", "y").alias("key"), "id", "n")


def _picked(docs: DataFrame, ids: DataFrame, band: Banding) -> DataFrame:
    """(id, text) of the documents in ids, one row each."""
    side = F.broadcast(ids) if ids.limit(band.broadcast_ids + 1).count() <= band.broadcast_ids else ids
    return docs.select(F.col("doc_id").alias("id"), "text").join(side, "id", "left_semi")


def _verified(pairs: DataFrame, sources: DataFrame, band: Banding) -> DataFrame:
    """Of the pairs (a, b, ca, cb) those whose full shingle sets are similar enough, as (ca, cb).

    The texts travel to the pairs, those of a first; sources are Parquet rows (id, text).
    """
    left = sources.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = sources.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def set_of(key: int, text: np.ndarray) -> np.ndarray:
            if key not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[key] = tk.shingle_set(tk.word_hashes(tk.LOWER[text]), band.words)
            return held[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, y, s, t in zip(a, b, texts(batch.column("text_a")), texts(batch.column("text_b"))):
                s, t = set_of(x, s), set_of(y, t)
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                keep.append(100 * common >= band.percent * (len(s) + len(t) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], ["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "ca long, cb long")


def _near(x: str, y: str, band: Banding) -> Column:
    """Set sizes alone exclude a pair if they differ too much."""
    return (F.col(x) * 100 >= F.col(y) * band.percent) & (F.col(y) * 100 >= F.col(x) * band.percent)


def _linked(members: DataFrame, labels: DataFrame, classes: DataFrame, sources: DataFrame, band: Banding) -> DataFrame:
    """(id, component) of all ids of members (key, id, n, rows) after checking the buckets' pairs.

    Only buckets that still hold several components matter.  If they have many pairs of different
    components, members of some buckets are first checked against a pivot of theirs, which makes
    large groups of near copies fall together.  Then all pairs that are left are checked: as rows
    if they are few for the members, else within blocks of members.
    """
    n_ids = labels.count()
    small = n_ids <= band.broadcast_ids // 2  # tables with a row for each id are broadcast then
    side = F.broadcast if small else (lambda df: df)
    rows, pairs = members.agg(F.count("*"), F.sum((F.col("rows") - 1) / 2)).first()
    placed = members.withColumn("component", F.col("id"))
    for turn in range(band.pivot_rounds + 1):
        if not rows:
            break
        few = pairs <= band.pairs_a_row * rows
        if few or turn < band.pivot_rounds:
            links = _verified(_pairs(placed, None if few else turn, band), sources, band)
        else:
            links = _in_blocks(placed.select("id", "n", "component").distinct(), classes, sources, band)
        merged = components(checkpointed(links.distinct()), "ca", "cb", small).select(F.col("id").alias("component"), F.col("component").alias("into"))
        labels = checkpointed(labels.join(side(merged), "component", "left").select("id", F.coalesce("into", "component").alias("component")))
        if few or turn == band.pivot_rounds:
            break
        placed = members.select("key", "id", "n").join(side(labels), "id")
        apart = placed.groupBy("key", "component").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("same"))
        apart = checkpointed(apart.filter("rows * rows > same"))
        rows, pairs = apart.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2)).first()
        placed = checkpointed(placed.join(apart.select("key"), "key"))
    return labels


def _pairs(placed: DataFrame, turn: int | None, band: Banding) -> DataFrame:
    """(a, b, ca, cb): all pairs of different components that share a bucket, or, in a turn of
    pivots, those of a member and the pivot of its bucket, for one in ``pivot_share`` buckets."""
    y = placed.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))
    if turn is None:
        x = placed.select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
        found = x.join(y, "key").filter((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _near("nx", "ny", band))
    else:
        some = F.pmod("key", F.lit(band.pivot_share)) == turn
        x = placed.filter(some).groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx")), F.xxhash64("id", "key")).alias("p")).select("key", "p.*")
        found = x.join(y.filter(some), "key").filter((F.col("cx") != F.col("cy")) & _near("nx", "ny", band))
    first = F.col("x") < F.col("y")
    pair = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
    return found.select(pair("x", "y").alias("a"), pair("y", "x").alias("b"), pair("cx", "cy").alias("ca"), pair("cy", "cx").alias("cb")).distinct()


def _in_blocks(ids: DataFrame, classes: DataFrame, sources: DataFrame, band: Banding) -> DataFrame:
    """(ca, cb) of all similar pairs of ids (id, n, component) that share a table.

    Two documents that share a table share a half-key of the first collection, so these m values
    are the buckets here.  Sizes that differ by more than the threshold exclude a pair, so a bucket
    is cut into levels of size of which only neighbours meet.  A bucket's largest component needs
    no comparison with itself: its other members, in blocks of bounded size, meet blocks of all
    members.  A task compares two blocks in memory, each pair only at the first half-key that it
    shares, and gives out links alone.
    """
    m = band.halves
    rows = ids.join(classes.select("id", "halves"), "id")
    level = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / band.percent)).cast("int")
    tables = rows.select("id", "n", "component", level.alias("level"), F.posexplode(F.slice("halves", 1, m)).alias("i", "x")).withColumn("key", F.xxhash64("i", "x"))
    each = checkpointed(tables.groupBy("key", "component", "level").agg(F.sum("n").alias("s")))
    big = each.groupBy("key", "component").agg(F.sum("s").alias("s")).groupBy("key").agg(F.max(F.struct("s", "component")).alias("big"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("big.component").alias("big"))
    blocks = lambda size: F.ceil(size / band.block_shingles).cast("int")
    levels = each.join(big, "key").groupBy("key", "big", "level").agg(blocks(F.sum("s")).alias("all"), blocks(F.sum(F.when(F.col("component") != F.col("big"), F.col("s")).otherwise(0))).alias("own"))
    levels = checkpointed(levels)
    # which levels' own blocks meet which levels' blocks of all members
    theirs = levels.select("key", F.col("level").alias("to"), "all")
    meet = levels.filter("own > 0").select("key", "big", F.col("level").alias("from"), "own", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("to")).join(theirs, ["key", "to"])
    meet = checkpointed(meet)
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = tables.select("key", "i", "id", "n", "component", "level")
    unit = ["key", "from", "to", "o", "a"]
    one = placed.join(meet.withColumn("level", F.col("from")), ["key", "level"]).filter("component <> big").withColumn("side", F.lit(0)).withColumn("o", F.pmod(F.xxhash64("id"), "own").cast("int")).withColumn("a", F.explode(spread("all")))
    two = placed.join(meet.withColumn("level", F.col("to")), ["key", "level"]).withColumn("side", F.lit(1)).withColumn("o", F.explode(spread("own"))).withColumn("a", F.pmod(F.xxhash64(F.lit(1), "id"), "all").cast("int"))
    names = [*unit, "i", "id", "component", "big", "side"]
    units = one.select(*names).unionByName(two.select(*names)).join(rows.select("id", "halves"), "id").join(sources, "id")

    def run(unit: pa.Table) -> pa.Table:
        side = unit.column("side").to_numpy()
        sets = [tk.shingle_set(tk.word_hashes(tk.LOWER[t]), band.words) for t in texts(unit.column("text"))]
        halves = np.array(unit.column("halves").to_pylist(), np.int64).reshape(len(sets), -1)
        size, ids, component = (np.array([len(s) for s in sets]) if c is None else unit.column(c).to_numpy() for c in (None, "id", "component"))
        i, big, links = unit.column("i")[0].as_py(), unit.column("big")[0].as_py(), set()
        others = np.flatnonzero(side == 1)
        for x in np.flatnonzero(side == 0).tolist():
            near = (100 * size[others] >= band.percent * size[x]) & (100 * size[x] >= band.percent * size[others])
            near &= (component[others] != component[x]) & ((component[others] == big) | (ids[others] > ids[x]))
            y = others[near]
            first = ~(halves[y, :i] == halves[x, :i]).any(1) if i else np.ones(len(y), bool)
            y = y[first & (halves[y, m:] == halves[x, m:]).any(1)]
            if not len(y):
                continue
            flat, ends = np.concatenate([sets[j] for j in y]), np.cumsum(size[y])
            at = np.searchsorted(sets[x], flat)
            hit = np.r_[0, np.cumsum(sets[x][np.minimum(at, size[x] - 1)] == flat)]
            common = hit[ends] - hit[ends - size[y]]
            for j in y[100 * common >= band.percent * (size[y] + size[x] - common)].tolist():
                links.add((min(component[x], component[j]).item(), max(component[x], component[j]).item()))
        return pa.table({"ca": pa.array([p for p, _ in links], pa.int64()), "cb": pa.array([q for _, q in links], pa.int64())})

    return units.groupBy(*unit).applyInArrow(run, "ca long, cb long")


def near_duplicates(docs: DataFrame, band: Banding = Banding()) -> DataFrame:
    """One row per distinct doc_id: doc_id, n_shingles, component_id, kept.

    Null or empty texts have the empty set and are linked with nothing; long texts have their whole
    set.  Repeated rows of a doc_id count once, by their smallest digest; of equal documents the
    smallest doc_id names the component.  A null doc_id is left out, as it can't name a component.
    No rows give no rows; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = columns(docs, "doc_id", "text").filter("doc_id is not null")
    rows = _sets(docs, band).groupBy("doc_id").agg(F.min(F.struct("n_shingles", "set1", "set2", "halves")).alias("s")).select("doc_id", "s.*")
    rows = written(rows, "sets")
    # classes of equal sets: partial minima, so a class of any size is combined before the shuffle
    classes = rows.filter("n_shingles > 0").groupBy("n_shingles", "set1", "set2").agg(F.min("doc_id").alias("id"), F.any_value("halves").alias("halves"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    keys = table_keys(classes, band)
    shared = keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = checkpointed(keys.join(shared, "key"))
    ids = checkpointed(members.select("id").distinct())
    sources = written(_picked(docs, ids, band).dropDuplicates(["id"]), "near")
    found = _linked(members, ids.select("id", F.col("id").alias("component")), classes, sources, band)
    # from representatives back to all rows; the representative's row of a hot class is repeated
    salts = 16
    some = F.broadcast if found.limit(band.broadcast_ids // 2 + 1).count() <= band.broadcast_ids // 2 else (lambda df: df)
    placed = classes.filter("copies > 1").select("n_shingles", "set1", "set2", "id").join(some(found), "id", "left").select("n_shingles", "set1", "set2", F.coalesce("component", "id").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    alone = found.select(F.col("id").alias("doc_id"), F.col("component").alias("own"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(placed, ["n_shingles", "set1", "set2", "salt"], "left").join(some(alone), "doc_id", "left")
    component = F.coalesce("component", "own", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, band: Banding = Banding()) -> DataFrame:
    """The rows of docs, with all their columns, one document for each component.

    Of repeated rows of a doc_id the one with the smallest text stays; rows with a null doc_id
    all stay.
    """
    rows = Rows(docs)
    found = checkpointed(near_duplicates(docs, band).select("doc_id", "kept"))
    gone = found.filter("not kept").select("doc_id")
    out = rows.frame.select("row", rows.column("doc_id").alias("doc_id")).join(few(gone, band.broadcast_ids), "doc_id", "left_anti")
    if rows.select("doc_id").filter("doc_id is not null").count() > found.count():
        one = out.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by("row", F.coalesce(rows.column("text"), F.lit(""))).alias("row"))
        out = one.select("row").unionByName(out.filter("doc_id is null").select("row"))
    return rows.unpacked(out)
