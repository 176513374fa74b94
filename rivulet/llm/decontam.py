"""Benchmark decontamination by winnowing.

A fingerprint of a word sequence is a k-gram hash that is the least of some window of w successive
k-gram hashes.  Two texts that share any w + k - 1 words share a window and so a fingerprint; with
w = windows - k + 1 no shared window of the contract's length can be missed.

Documents' fingerprints are joined with the benchmark's.  Both carry the word hashes up to w - 1
words to either side of their k-gram, by which a hit is extended as far as both texts agree: every
shared window that holds the k-gram lies within these words, so texts needn't meet.  Runs that
reach the window length are hit words.  Items too short for a window are joined whole, by the hash
of their words and their own length.

A Bloom filter of the benchmark's hashes, of bounded size, goes to the one pass over the documents
and keeps back most fingerprints that join with nothing.  It only saves shuffling: if the benchmark
outgrows it, more rows reach the join and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm import textkernel as tk
from rivulet.llm.runtime import Rows, checkpointed, columns, few, texts, tune, written

U64 = np.uint64


@dataclass(frozen=True)
class Winnow:
    """Production parameters: window and k-gram in words, least share of hit words, most bits of
    the Bloom filter (a power of two), most rows of a table that is broadcast."""

    window: int = 13
    k: int = 5
    one_in: int = 20
    bloom_bits: int = 1 << 27
    broadcast_rows: int = 20_000


def fingerprints(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of w; ties are all taken."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1) if n < 64 else _slide(grams, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)])
    return np.flatnonzero(grams == _slide(padded, w, np.maximum))


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """The minimum or maximum of each w successive values, by doubling."""
    span, out = 1, x
    while span < w:
        step = min(span, w - span)
        out = best(out[: len(out) - step], out[step:])
        span += step
    return out


def _around(words: np.ndarray, at: np.ndarray, win: Winnow, pad: int) -> np.ndarray:
    """A row for each place: the hashes of the k-gram there and of the words on either side of it.

    Beyond the text's ends stands pad, which differs between documents and items.
    """
    side = win.window - win.k
    wide = np.concatenate([np.full(side, pad, U64), words, np.full(side, pad, U64)])
    return wide[at[:, None] + np.arange(2 * side + win.k)].view(np.int64)


def _words(text: np.ndarray) -> np.ndarray:
    return tk.word_hashes(tk.LOWER[text], tk.ALNUM)


# The benchmark --------------------------------------------------------------------------------


def _postings(items: DataFrame, win: Winnow) -> DataFrame:
    """(id, one, two, n, h, around): the fingerprints of items, or one row for a short item.

    one and two are a digest of the item's words; n is the length of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one, two, n, h, around = [], [], [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), texts(batch.column("text"))):
                words = _words(t)
                if not len(words):
                    continue
                size = min(len(words), win.window)
                if size < win.window:
                    hashes, rows = tk.gram_hashes(words, size), [None]
                else:
                    grams = tk.gram_hashes(words, win.k)
                    at = fingerprints(grams, win.window - win.k + 1)
                    hashes, rows = grams[at], _around(words, at, win, 1).tolist()
                whole = [int(tk.mix(words + U64(s)) @ tk.powers(len(words))) & (1 << 63) - 1 for s in (1, 2)]
                h += hashes.view(np.int64).tolist()
                around += rows
                ids += [i] * len(rows)
                n += [size] * len(rows)
                one += whole[:1] * len(rows)
                two += whole[1:] * len(rows)
            cols = [pa.array(ids, pa.string()), *(pa.array(x, pa.int64()) for x in (one, two)), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(around, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "one", "two", "n", "h", "around"])

    return items.mapInArrow(run, "id string, one long, two long, n int, h long, around array<long>")


def _probes(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The two places of each hash in the filter."""
    x = tk.mix(h + U64(n))
    return np.stack([x & U64(bits - 1), (x >> U64(32)) & U64(bits - 1)]).astype(np.int64)


def _bloom(hashes: DataFrame, win: Winnow) -> np.ndarray:
    """The filter's bytes for a table (n, h); at most bloom_bits / 8 of them, by any benchmark."""
    bits = 1 << 16
    rows = hashes.count()
    while bits < win.bloom_bits and bits < 16 * rows:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, U64)
        for batch in batches:
            n, h = (batch.column(c).to_numpy() for c in ("n", "h"))
            for size in np.unique(n).tolist():
                at = _probes(h[n == size].view(U64), size, bits).ravel()
                np.bitwise_or.at(held, at >> 6, U64(1) << (at & 63).astype(U64))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], ["at", "word"])

    found = hashes.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(U64)
    return out


def _member(bloom: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    at = _probes(h, n, 64 * len(bloom))
    return ((bloom[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool).all(axis=0)


# Documents ------------------------------------------------------------------------------------

_FOUND = "array<struct<n:int,h:long,at:array<int>,around:array<long>>>"


def _candidates(docs: DataFrame, bloom: np.ndarray, short: list[int], win: Winnow) -> DataFrame:
    """(doc_id, k1, k2, n_words, found): of each row of docs (doc_id, text, k1, k2) the hashes that
    the filter has, with their places."""
    held = docs.sparkSession.sparkContext.broadcast(bloom)
    kind = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("around", pa.list_(pa.int64()))]))

    def of(words: np.ndarray) -> list[dict]:
        out = []
        if len(words) >= win.window:
            grams = tk.gram_hashes(words, win.k)
            at = fingerprints(grams, win.window - win.k + 1)
            at = at[_member(held.value, grams[at], win.window)]
            if len(at):
                out += [{"n": win.window, "h": h, "at": [p], "around": a} for h, p, a in zip(grams[at].view(np.int64).tolist(), at.tolist(), _around(words, at, win, 0).tolist())]
        for n in short:
            if len(words) >= n:
                grams = tk.gram_hashes(words, n)
                at = np.flatnonzero(_member(held.value, grams, n))
                if len(at):
                    at = at[np.argsort(grams[at], kind="stable")]
                    own = grams[at]
                    groups = np.split(at, np.flatnonzero(own[1:] != own[:-1]) + 1)
                    out += [{"n": n, "h": int(grams[g[0]].view(np.int64)), "at": g.tolist(), "around": None} for g in groups]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in texts(batch.column("text"))]
            cols = [batch.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array([len(w) for w in words], pa.int64()), pa.array([of(w) for w in words], kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k1", "k2", "n_words", "found"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n_words long, found {_FOUND}")


def _extended(win: Winnow) -> tuple[Column, Column]:
    """By how many words a hit's k-gram can be extended to the left and right; null if it differs."""
    side, k = win.window - win.k, win.k
    same = lambda i: F.element_at("around", i) == F.element_at("theirs", i)
    part = lambda lo, hi: F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda i: ~same(i))
    left = F.lit(side) - F.coalesce(F.array_max(part(1, side)), F.lit(0))
    right = F.coalesce(F.array_min(part(side + k + 1, 2 * side + k)), F.lit(2 * side + k + 1)) - F.lit(side + k + 1)
    return left, F.when(F.size(part(side + 1, side + k)) == 0, right)


def _hits(found: DataFrame, postings: DataFrame, win: Winnow) -> DataFrame:
    """(k1, k2, one, two, lo, hi): the ranges of a document's words that an item's words hit."""
    theirs = postings.groupBy("n", "h", F.col("around").alias("theirs")).agg(F.collect_set(F.struct("one", "two")).alias("items"))
    own = found.filter(F.size("found") > 0).select("k1", "k2", F.explode("found").alias("x")).select("k1", "k2", "x.*")
    own = own.dropDuplicates(["k1", "k2", "n", "h", "at"])
    joined = own.join(few(checkpointed(theirs), win.broadcast_rows), ["n", "h"])
    left, right = _extended(win)
    runs = joined.withColumn("left", F.when(F.col("n") < win.window, 0).otherwise(left)).withColumn("right", F.when(F.col("n") < win.window, F.col("n")).otherwise(right + win.k))
    runs = runs.filter((F.col("n") < win.window) | (F.col("left") + F.col("right") >= win.window))
    return runs.select("k1", "k2", "items", F.explode("at").alias("p"), "left", "right").select("k1", "k2", "items", (F.col("p") - F.col("left")).alias("lo"), (F.col("p") + F.col("right")).alias("hi"))


def _marked(rows: DataFrame, benchmark: DataFrame, win: Winnow) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, ids, bad) of each row of a table (doc_id, text, k1, k2).

    k1 and k2 are a digest of doc_id and text: rows that have both in common are hit alike.
    """
    items = columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("id"), "text").filter("id is not null and text is not null")
    postings = written(_postings(items, win), "postings")
    short = sorted(r.n for r in postings.filter(F.col("n") < win.window).select("n").distinct().collect())
    bloom = _bloom(postings.select("n", "h"), win)
    found = written(_candidates(rows, bloom, short, win), "found")
    hits = checkpointed(_hits(found, postings, win))
    # a document's ranges in order: each adds what lies beyond all before it
    before = F.max("hi").over(Window.partitionBy("k1", "k2").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    ranges = hits.groupBy("k1", "k2", "lo").agg(F.max("hi").alias("hi")).withColumn("seen", F.coalesce(before, F.lit(0)))
    n_hit = ranges.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "seen"))).cast("long").alias("n_hit"))
    known = postings.select("one", "two", "id").distinct()
    named = hits.select("k1", "k2", F.explode("items").alias("i")).select("k1", "k2", "i.*").distinct().join(few(known, win.broadcast_rows), ["one", "two"])
    ids = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    hit = checkpointed(n_hit.join(ids, ["k1", "k2"]))
    out = found.select("doc_id", "k1", "k2", "n_words").join(few(hit, win.broadcast_rows), ["k1", "k2"], "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return out.withColumn("bad", (F.col("n_hit") > 0) & (F.col("n_hit") * win.one_in >= F.col("n_words")))


def _digest(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")


def contamination(docs: DataFrame, benchmark: DataFrame, win: Winnow = Winnow()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; long texts are searched whole; items without
    an id, text or words have no window; repeated items count once by id; repeated rows get equal
    results; an empty benchmark contaminates nothing and no rows give no rows.  Extra columns are
    ignored, whatever their names.
    """
    tune(docs.sparkSession)
    rows = columns(docs, "doc_id", "text")
    out = _marked(rows.select("doc_id", "text", *_digest(F.col("doc_id"), F.col("text"))), benchmark, win)
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), F.col("bad").alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, win: Winnow = Winnow()) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated; cases as above.

    The texts are read a second time and not shuffled unless very many documents go.
    """
    tune(docs.sparkSession)
    rows = Rows(docs)
    own = _digest(rows.column("doc_id"), rows.column("text"))
    found = _marked(rows.frame.select(rows.column("doc_id").alias("doc_id"), rows.column("text").alias("text"), *own), benchmark, win)
    gone = checkpointed(found.filter("bad").select("k1", "k2").distinct())
    kept = rows.frame.select("row", *own).join(few(gone, 50 * win.broadcast_rows), ["k1", "k2"], "left_anti")
    return rows.unpacked(kept)


#: The contract in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM items)),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT DISTINCT r, p, grams.k AS k, item_id FROM grams JOIN wins USING (k, g)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT r, p, k FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
