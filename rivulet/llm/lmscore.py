"""Complete-document log-likelihoods under a gated recurrent language model.

Spark counts every token of the training documents.  The most frequent words are the network's
vocabulary; all other words share classes by their shape, and within a class have the probability
of their smoothed count, so every text has a proper probability.

Documents are encoded once, as the network's tokens.  The training documents are dealt to shards by
a hash of id and text, whose number follows the corpus alone; in each of a few rounds a part of the
shards is trained on, every shard by a copy of the network of its own, and the copies are averaged
by tokens seen.  The rounds begin with few shards and together hold each training document once, so
later rounds start from what earlier ones learned, and the result doesn't depend on how Spark
partitions the input.  The first round makes an update for each window; later ones make one for a
whole stretch of windows in which only the few lanes of long texts go on.

The counts of the ``dictionary`` most frequent words go to the tasks as a sorted hash array of
bounded size.  The tokens beyond it are joined with the counts by hash; each is at most one in
``dictionary`` of all tokens, so no key of that join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import textkernel as tk
from rivulet.llm.gru import Gru, Shape, Trainer, score
from rivulet.llm.hasharray import HashArray
from rivulet.llm.runtime import buffers, columns, crc_mod, packs, tune, written

U64 = np.uint64
END = U64(0x1D872B41C9A3F065)


@dataclass(frozen=True)
class Lm:
    """Production parameters."""

    shape: Shape = Shape()
    modulus: int = 7
    held_out: int = 2
    dictionary: int = 1 << 18
    #: Training tokens of a shard, on average, and the parts of the shards at which rounds end.
    shard_tokens: int = 500_000
    rounds: tuple[float, ...] = (1 / 16, 1 / 4, 1 / 2, 1)
    #: Tokens that a task scores at a time, unless one text has more.
    group: int = 1_000_000


_SHAPE_OF_FIRST = np.full(256, 15, np.uint8)
_SHAPE_OF_FIRST[0x61:0x7B] = np.arange(26) // 2
_SHAPE_OF_FIRST[0x30:0x3A] = 13
_SHAPE_OF_FIRST[0x80:] = 14
_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the words and ends of many texts in one buffer, and where each text begins.

    The texts lie between the offsets.
    """
    text = tk.LOWER[data[offsets[0] : offsets[-1]]]
    words, starts, ends, first = tk.all_words(text, offsets - offsets[0])
    n = len(first) - 1
    at = first + np.arange(n + 1)  # an end stands after each text's words
    h, shape = np.empty(len(words) + n, U64), np.zeros(len(words) + n, np.uint8)
    is_word = np.ones(len(h), bool)
    is_word[at[1:] - 1] = False
    h[at[1:] - 1] = END
    h[is_word] = words
    if len(words):
        shape[is_word] = _SHAPE_OF_FIRST[text[starts]] * 2 + _STOPS[text[ends - 1]]
    return h, shape, at


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of a column of texts with their tokens."""
    data, offsets = buffers(column)
    for lo, hi in packs(column):
        yield lo, hi, *tokens(data, offsets[lo : hi + 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, s, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, s, c = h[order], s[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], s[first], np.add.reduceat(c, first)

    def out() -> pa.RecordBatch:
        h, s, c = merged()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], ["h", "s", "c"])

    for batch in batches:
        for _, _, h, s, _ in _parts(batch.column("text")):
            h, first, c = np.unique(h, return_index=True, return_counts=True)
            held.append((h, s[first], c.astype(np.int64)))
            size += len(h)
        if size > 1 << 21:
            held = [merged()]
            size = len(held[0][0])
            if size > 1 << 20:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, s, c): hash, shape and count of each distinct token of docs (text)."""
    return docs.select("text").mapInArrow(_count, "h long, s int, c long").groupBy("h").agg(F.any_value("s").alias("s"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need to turn hashes into tokens and counts."""

    total: int
    distinct: int
    ids: HashArray
    counts: HashArray
    #: The rank of counts (see count_rank) from which on tokens are in the dictionary.
    least: int
    complete: bool
    #: log10 of the counts' sum plus types plus one, for each rare class.
    rare_log: np.ndarray
    token_counts: np.ndarray
    end: int

    def encode(self, h: np.ndarray, s: np.ndarray, shape: Shape) -> np.ndarray:
        found, i = self.ids.get(h)
        return np.where(found, i, shape.words + s.astype(np.int32)).astype(np.int32)


def count_rank(c: Column) -> Column:
    """A rising function of a count with few values: exact up to 4095, then 64 steps an octave."""
    return F.when(c < 4096, c).otherwise(4096 + F.floor(64 * F.log2(c / 4096))).cast("long")


def vocabulary(counts: DataFrame, lm: Lm) -> Vocabulary:
    """From token_counts()'s table; the driver gets the most frequent tokens only.

    How many tokens have each count decides from which count on at most ``dictionary`` are taken.
    """
    by_shape = counts.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("k")).toArrow()
    shape, held, types_of = (by_shape.column(x).to_numpy() for x in ("s", "c", "k"))
    ranks = counts.groupBy(count_rank(F.col("c")).alias("r")).agg(F.count("*").alias("k")).toArrow().sort_by([("r", "descending")])
    fits = ranks.column("r").to_numpy()[np.cumsum(ranks.column("k").to_numpy()) <= lm.dictionary]
    least = int(fits[-1]) if len(fits) else 1 << 40
    top = counts.filter(count_rank(F.col("c")) >= least).toArrow()
    h, s, c = (top.column(x).combine_chunks().to_numpy() if len(top) else np.zeros(0, np.int64) for x in ("h", "s", "c"))
    order = np.lexsort((h, -c))
    h, s, c = h[order].view(U64), s[order], c[order]
    n, words = lm.shape.rare_classes, lm.shape.words
    sums, types = np.zeros(n), np.zeros(n)
    sums[shape], types[shape] = held, types_of
    at_end = np.flatnonzero(h[:words] == END)
    order = np.arange(min(words, len(h)))
    if not len(at_end):  # the end is always in the network's vocabulary
        order = order[: words - 1]
    own_h, own_s, own_c = h[order], s[order], c[order]
    np.subtract.at(sums, own_s, own_c)
    np.subtract.at(types, own_s, 1)
    if not len(at_end):
        own_h, own_c = np.append(own_h, END), np.append(own_c, 0)
    per_token = np.zeros(lm.shape.inputs)
    per_token[: len(own_h)] = own_c
    per_token[words:] = sums
    end = int(np.flatnonzero(own_h == END)[0])
    distinct = int(types_of.sum())
    return Vocabulary(int(held.sum()), distinct, HashArray(own_h, np.arange(len(own_h), dtype=np.int32)), HashArray(h, c), least, distinct <= len(h), np.log10(sums + types + 1), per_token, end)


_ENCODED = "row long, doc_id long, k long, held_out boolean, n_tokens long, n_known long, log_c double, inside double, ids binary, tail array<struct<h:long,n:long>>"


def encoded(docs: DataFrame, vocab: Vocabulary, lm: Lm) -> DataFrame:
    """A row for each row of docs (row, doc_id, k, held_out, text): its tokens as 16-bit numbers, the
    counts' logarithms, and the tokens beyond the dictionary with how often they occur."""
    shape, held = lm.shape, docs.sparkSession.sparkContext.broadcast(vocab)
    tail_kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            counted, sums, ids, tails = [], [], [], []
            for _, _, h, s, at in _parts(batch.column("text")):
                y = v.encode(h, s, shape)
                found, c = v.counts.get(h)
                log_c = np.log10(c + 1.0)
                rare = y >= shape.words
                inside = np.zeros(len(h))
                inside[rare] = log_c[rare] - v.rare_log[y[rare] - shape.words]
                counted.append((np.diff(at), np.add.reduceat(c > 0, at[:-1], dtype=np.int64)))
                sums.append((np.add.reduceat(log_c, at[:-1]), np.add.reduceat(inside, at[:-1])))
                raw = y.astype("<i2").tobytes()
                ids += [raw[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                lost = np.flatnonzero(~found) if not v.complete else np.zeros(0, np.int64)
                bounds = np.searchsorted(lost, at).tolist()
                for a, b in zip(bounds[:-1], bounds[1:]):
                    beyond, n = np.unique(h[lost[a:b]], return_counts=True) if b > a else (h[:0], h[:0])
                    tails.append([{"h": x, "n": k} for x, k in zip(beyond.view(np.int64).tolist(), n.tolist())])
            cat = lambda parts, i: pa.array(np.concatenate([x[i] for x in parts]) if parts else np.zeros(0))
            cols = [cat(counted, 0).cast(pa.int64()), cat(counted, 1).cast(pa.int64()), cat(sums, 0), cat(sums, 1), pa.array(ids, pa.binary()), pa.array(tails, tail_kind)]
            first = ["row", "doc_id", "k", "held_out"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in first), *cols], [*first, "n_tokens", "n_known", "log_c", "inside", "ids", "tail"])

    out = written(docs.mapInArrow(run, _ENCODED), "encoded")
    held.destroy()
    return out


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i2").astype(np.int32) for x in column]


def train(docs: DataFrame, vocab: Vocabulary, lm: Lm) -> Gru:
    """docs: encoded()'s rows of the training documents."""
    shape, end = lm.shape, vocab.end
    state = Trainer(Gru.initial(shape, vocab.token_counts))
    shards = max(1, -(-vocab.total // lm.shard_tokens))
    rows = docs.select(F.pmod("k", F.lit(shards)).alias("shard"), "k", "ids")
    done = 0
    for share in lm.rounds:
        upto = min(shards, max(done + 1, round(shards * share)))
        if upto <= done:
            break
        held = docs.sparkSession.sparkContext.broadcast(state.to_bytes())

        def local(batches: Iterator[pa.RecordBatch], held: Broadcast = held, begun: bool = done > 0) -> Iterator[pa.RecordBatch]:
            at, group = None, []
            for batch in batches:
                for shard, ids in zip(batch.column("shard").to_pylist(), _ids(batch.column("ids"))):
                    if shard != at and group:
                        yield _trained(held.value, shape, at, group, end, begun)
                        group = []
                    at = shard
                    group.append(ids)
            if group:
                yield _trained(held.value, shape, at, group, end, begun)

        own = rows.filter((F.col("shard") >= done) & (F.col("shard") < upto)).repartitionByRange(upto - done, "shard").sortWithinPartitions("shard", "k", "ids")
        state = _averaged(written(own.mapInArrow(local, _COPY), "copies"), shape) or state
        held.destroy()
        done = upto
    return state.net


_COPY = "shard long, w binary, n long"


def _trained(raw: bytes, shape: Shape, shard: int, group: list[np.ndarray], end: int, begun: bool) -> pa.RecordBatch:
    own = Trainer.from_bytes(shape, raw)
    seen = own.run(group, end, begun)[0]
    return _blob(shard, own.to_bytes(), seen)


def _blob(shard: int, raw: bytes, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([raw], pa.binary()), pa.array([n], pa.int64())], ["shard", "w", "n"])


def _averaged(copies: DataFrame, shape: Shape) -> Trainer | None:
    """The mean of all copies, sixteen at a time; the driver gets at most sixteen."""
    n = copies.count()
    while n > 16:
        n = -(-n // 16)
        copies = copies.withColumn("shard", F.floor(F.col("shard") / 16)).repartitionByRange(n, "shard").sortWithinPartitions("shard", "n", "w")
        copies = written(copies.mapInArrow(_means, _COPY), "copies")
        n = copies.count()
    rows = copies.withColumn("shard", F.lit(0).cast("long")).sort("n", "w")
    last = list(_means(iter(rows.toArrow().to_batches())))
    return Trainer.from_bytes(shape, last[0].column("w")[0].as_py()) if last else None


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard the mean of its copies by tokens seen, one copy at a time."""
    at, total, seen = None, None, 0
    for batch in batches:
        for shard, raw, n in zip(batch.column("shard").to_pylist(), batch.column("w"), batch.column("n").to_pylist()):
            if shard != at and seen:
                yield _blob(at, (total / seen).astype(np.float32).tobytes(), seen)
                total, seen = None, 0
            w = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * n
            at, total, seen = shard, w if total is None else total + w, seen + n
    if seen:
        yield _blob(at, (total / seen).astype(np.float32).tobytes(), seen)


def likelihoods(docs: DataFrame, lm: Lm = Lm()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is the end token alone; a long text is one sequence and is scored whole.
    Repeated rows count, are learned from and are scored as often as they come.  Without training
    documents all counts are 0; no rows give no rows.  Equal counts are ranked by the tokens' hashes.
    Extra columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    spark, shape = docs.sparkSession, lm.shape
    plain = columns(docs, "doc_id", "text")
    held_out = (crc_mod(F.col("doc_id"), lm.modulus) == lm.held_out).alias("held_out")
    counts = written(token_counts(plain.filter(~held_out)), "tokens")
    vocab = vocabulary(counts, lm)
    rows = encoded(plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("k"), held_out, "text"), vocab, lm)
    net = train(rows.filter("not held_out"), vocab, lm)
    held, end = spark.sparkContext.broadcast(net.to_bytes()), vocab.end
    first = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gru.from_bytes(shape, held.value)
        kept, group, size = [], [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept).combine_chunks()
            ln = score(own, group, end) / np.log(10)
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in first), pa.array(ln)], [*first, "ln"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                kept.append(part.select(first))
                group += _ids(part.column("ids"))
                size += sum(len(x) for x in group[-part.num_rows :])
                if size >= lm.group:
                    yield flush()
                    kept, group, size = [], [], 0
        if kept:
            yield flush()

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, inside double, ln double"
    scored = rows.select(*first, "ids").mapInArrow(run, kind)
    if vocab.complete:
        more = scored.withColumn("tail_known", F.lit(0).cast("long")).withColumn("tail_log", F.lit(0.0))
    else:
        tail = rows.filter(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.*")
        beyond = counts.filter(count_rank(F.col("c")) < vocab.least).select("h", "c")
        sums = tail.join(beyond, "h").groupBy("row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
        more = scored.join(sums, "row", "left").withColumn("tail_known", F.coalesce("tail_known", F.lit(0))).withColumn("tail_log", F.coalesce("tail_log", F.lit(0.0)))
    total, denominator = vocab.total, float(np.log10(vocab.total + vocab.distinct + 1))
    return more.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("tail_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.col("tail_log") - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("ln") + F.col("inside") + F.col("tail_log")).alias("score"),
    )
