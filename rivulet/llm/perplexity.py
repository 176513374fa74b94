"""N-gram perplexity rules: a modified Kneser-Ney model over UTF-8 bytes, counted by Spark.

Each language has its own model of order 5.  Spark counts the 5-grams of every whole text and
derives the lower orders' continuation counts, the discounts and the normalisers from them with
ordinary aggregates.  The texts that are scored are those that were counted, so every 5-gram of
theirs is in the table, and its probability, interpolated through all orders, follows from joins.
What the executors get is sorted hash arrays of all 5-grams' log10 probabilities, dealt into blocks
of about ``block_entries``; a task holds one block at a time.  No n-gram is left out at any size.

Each language gets a band of log-perplexity around its median, some robust standard deviations
wide on either side and wider for short texts; documents outside are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm import textkernel as tk
from rivulet.llm.hasharray import HashArray
from rivulet.llm.runtime import Rows, checkpointed, few, packs, texts, tune, written

ORDER = 5
U64 = np.uint64
_PAD = b"\x02" * (ORDER - 1)
_GRAM_BITS = 8 * ORDER
_TAG = U64((1 << 24) - 1)
#: Width of a step in which log10 perplexities are counted for the bands.
STEP = 0.0005
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    block_entries: int = 1 << 21
    width_low: float = 4.0
    width_high: float = 3.0
    least_spread: float = 0.002
    settle_bytes: int = 1500
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def lang_tag(lang: str | None) -> int:
    """24 bits that stand for a language; null is a language of its own."""
    return (tk.lane_hash(lang) if lang is not None else 0) & int(_TAG)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all rows, each after a pad; where each begins; its length."""
    lens = np.array([len(r) for r in rows], np.int64)
    buffer = np.frombuffer(b"".join(x for r in rows for x in (_PAD, r.tobytes())), np.uint8)
    return buffer, np.cumsum(lens + len(_PAD)) - lens, lens


def _grams(rows: list[np.ndarray], tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed 5-gram that ends at each byte, with its language's tag, row after row."""
    buffer, first, lens = _padded(rows)
    at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    key = np.zeros(len(buffer), U64)
    for j in range(ORDER):
        key[ORDER - 1 :] |= buffer[j : len(buffer) - ORDER + 1 + j].astype(U64) << U64(8 * (ORDER - 1 - j))
    return key[at] | np.repeat(tags << U64(_GRAM_BITS), lens), first, lens


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition's 5-grams; flushed when many are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    known: dict[str | None, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        keys, counts = _merged(held)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "c"])

    for batch in batches:
        column, langs = batch.column("text"), batch.column("lang").to_pylist()
        rows = list(texts(column))
        for lo, hi in packs(column):
            tags = np.array([known.setdefault(x, lang_tag(x)) for x in langs[lo:hi]], U64)
            keys, counts = np.unique(_grams(rows[lo:hi], tags)[0], return_counts=True)
            held.append((keys, counts.astype(np.int64)))
            size += len(keys)
            if size > 1 << 20:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(n, gram, c): raw counts at order 5, below it the number of different left neighbours.

    gram packs the language's tag and n bytes.
    """
    top = docs.select("text", "lang").mapInArrow(_count, "gram long, c long")
    level = checkpointed(top.groupBy("gram").agg(F.sum("c").alias("c")))
    tag = F.lit(~((1 << _GRAM_BITS) - 1))
    out = level.select(F.lit(ORDER).alias("n"), "gram", "c")
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(tag).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)))
        level = level.groupBy(suffix.alias("gram")).agg(F.count("*").alias("c"))
        out = out.unionByName(level.select(F.lit(n).alias("n"), "gram", "c"))
    return checkpointed(out)


def _hashed(keys: np.ndarray) -> np.ndarray:
    """A bijection and so without collisions."""
    return tk.mix(keys + U64(ORDER))


def _discounts(counts: DataFrame) -> DataFrame:
    """(n, tag, d1, d2, d3): each order's and language's discounts of counts 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    rows = counts.groupBy("n", F.shiftrightunsigned("gram", _GRAM_BITS).alias("tag")).agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.try_divide(n1, n1 + 2 * n2)
    estimates = [1 - 2 * y * F.try_divide(n2, n1), 2 - 3 * y * F.try_divide(n3, n2), 3 - 4 * y * F.try_divide(n4, n3)]
    enough = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)  # else too few n-grams to estimate them
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i + 0.95), F.when(enough, x).otherwise(plain))).alias(f"d{i + 1}") for i, (x, plain) in enumerate(zip(estimates, (0.5, 0.75, 0.9)))]
    return rows.select("n", "tag", *d)


def _context() -> Column:
    tag = F.col("gram").bitwiseAND(F.lit(~((1 << _GRAM_BITS) - 1)))
    return F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << _GRAM_BITS) - 1)), 8).bitwiseOR(tag)


def probabilities(counts: DataFrame) -> DataFrame:
    """(gram, v): log10 p of each 5-gram's last byte after the others, of gram_counts()'s table.

    A context or a suffix has at most 256 n-grams, so no key of the window or the joins is hot.
    """
    side = few(checkpointed(_discounts(counts)), 4096 * ORDER)
    own = counts.withColumn("tag", F.shiftrightunsigned("gram", _GRAM_BITS)).join(side, ["n", "tag"])
    own = own.select("n", "gram", "c", _context().alias("context"), F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
    w = Window.partitionBy("n", "context")
    total = F.sum("c").over(w)
    own = checkpointed(own.select("n", "gram", ((F.col("c") - F.col("d")) / total).alias("own"), (F.sum("d").over(w) / total).alias("gamma")))
    p = own.filter("n = 1").select("gram", (F.col("own") + F.col("gamma") / 256).alias("p"))
    for n in range(2, ORDER + 1):
        suffix = F.col("gram").bitwiseAND(F.lit(~((1 << _GRAM_BITS) - 1) | ((1 << 8 * (n - 1)) - 1)))
        lower = p.select(F.col("gram").alias("suffix"), "p")
        p = own.filter(F.col("n") == n).withColumn("suffix", suffix).join(lower, "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("p")).alias("p"))
    return p.select("gram", F.log10("p").cast("float").alias("v"))


#: Both are below 2^31, so that products of residues fit in a long.
_PRIME, _FACTOR = (1 << 31) - 1, 48271


def blocks(table: DataFrame, rules: Rules = Rules()) -> list[Broadcast]:
    """Sorted hash arrays of probabilities()'s table; the driver holds one block at a time."""
    table = checkpointed(table)
    n = max(1, -(-table.count() // rules.block_entries))
    dealt = F.pmod(F.pmod("gram", F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)) % n
    out = []
    for i in range(n):
        found = table.filter(dealt == i).toArrow()
        keys, v = (found.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("gram", "v"))
        out.append(table.sparkSession.sparkContext.broadcast(HashArray(_hashed(keys.view(U64)), v)))
    return out


def _looked_up(held: list[Broadcast], keys: np.ndarray) -> np.ndarray:
    """log10 p of packed 5-grams; of several blocks only one is in memory."""
    out = np.zeros(len(keys))
    block = np.mod(np.mod(keys.view(np.int64), _PRIME) * _FACTOR, _PRIME) % len(held) if len(held) > 1 else None
    for i, b in enumerate(held):
        own = slice(None) if block is None else np.flatnonzero(block == i)
        found, out[own] = b.value.get(_hashed(keys[own]))
        if not found.all():
            raise ValueError("a text has changed since its n-grams were counted")
        if block is not None and b._path is not None:
            b.__dict__.pop("_value", None)  # read again from the local file when it's needed
    return out


def base_counts(text: np.ndarray, window: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    starts, ends = tk.spans(text, tk.WORD)
    n = len(starts)
    if not n:
        return 0, 0, 0, 0, 0
    bytes_of = np.bincount(text, minlength=256)
    lines = [x for x in text.tobytes().split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    grams = tk.gram_hashes(tk.run_hashes(text, starts, ends), window) if n >= window else np.zeros(0, U64)
    repeated = 0
    if len(grams):
        _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        first = np.flatnonzero(count[inverse] > 1)
        if len(first):
            edge = np.zeros(n + 1, np.int32)
            edge[first] += 1
            edge[first + window] -= 1
            repeated = int((np.cumsum(edge) > 0).sum())
    return n, int(bytes_of[tk.WORD & tk.LEAD].sum()), int(bytes_of[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated


_SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, base_failed boolean, log_ppl double"


def scored(docs: DataFrame, held: list[Broadcast], rules: Rules, rows: Rows | None = None) -> DataFrame:
    """The base counts and log10 perplexity (a byte) of each row: doc_id, lang and columns q_*.

    docs has doc_id, text and lang; with rows it is their frame, and row is carried along.
    """
    names = [x.split()[0] for x in _SCORED.split(", ")]
    place = {c: rows.place(c) for c in ("text", "lang")} if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        for batch in batches:
            own = (lambda name: batch.column("row").field(place[name])) if place else batch.column  # noqa: B023
            column, langs = own("text"), own("lang")
            tags_of = np.array([known.setdefault(x, lang_tag(x)) for x in langs.to_pylist()], U64)
            every = list(texts(column))
            log_ppl: list[float | None] = []
            for lo, hi in packs(column, 1 << 20 if len(held) == 1 else 1 << 22):
                keys, _, lens = _grams(every[lo:hi], tags_of[lo:hi])
                sums = np.r_[0.0, np.cumsum(_looked_up(held, keys))]
                ends = np.cumsum(lens)
                log_ppl += [-(sums[e] - sums[e - n]) / n if n else None for e, n in zip(ends.tolist(), lens.tolist())]
            base = [base_counts(r, rules.window) for r in every]
            failed = [b[0] < rules.min_words or 100 * b[4] > rules.max_repeat_percent * b[0] for b in base]
            cols = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)] + [pa.array([len(r) for r in every], pa.int64()), pa.array(failed, pa.bool_()), pa.array(log_ppl, pa.float64())]
            carried = {"row": batch.column("row"), "lang": langs} if place else {"doc_id": batch.column("doc_id"), "lang": langs}
            yield pa.RecordBatch.from_arrays([*carried.values(), *cols], [*carried, *(f"q_{c}" for c in names)])

    more = ", ".join(f"q_{x}" for x in _SCORED.split(", "))
    if rows:
        return rows.frame.mapInArrow(run, rows.schema(f"lang string, {more}"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {more}")


def _quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Each language's quantiles of a column over the rows that passed the base rules.

    Values are counted in steps first, so a language of any size is summed before it is shuffled.
    """
    usable = rows.filter(~F.col("q_base_failed") & F.col(value).isNotNull())
    hist = usable.groupBy(F.col("lang").alias("b_lang"), F.floor(F.col(value) / STEP).alias("s")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("b_lang")
    run = hist.withColumn("upto", F.sum("k").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(w))
    at = lambda share: (F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("s"))) + 0.5) * STEP
    return run.groupBy("b_lang").agg(*(at(x).alias(name) for name, x in shares.items()))


def _with_lang(rows: DataFrame, per_lang: DataFrame) -> DataFrame:
    """Join a row for each language; broadcast if there are few."""
    return rows.join(few(per_lang, 4096), F.col("lang").eqNullSafe(F.col("b_lang")), "left").drop("b_lang")


def _judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds b_low and b_high, each row's bounds of log10 perplexity, and q_kept.

    The mean over few bytes varies more, so a band widens as sqrt(1 + settle_bytes / bytes).
    """
    rows = _with_lang(rows, _quantiles(rows, "q_log_ppl", {"b_mid": 0.5}))
    settle = F.sqrt(1 + F.lit(rules.settle_bytes) / F.greatest("q_n_bytes", F.lit(1)))
    rows = rows.withColumn("b_dev", (F.col("q_log_ppl") - F.col("b_mid")) / settle)
    rows = _with_lang(rows, _quantiles(rows, "b_dev", {"b_q1": 0.25, "b_q3": 0.75}))
    spread = F.greatest((F.col("b_q3") - F.col("b_q1")) / 1.349, F.lit(rules.least_spread)) * settle
    rows = rows.withColumn("b_low", F.col("b_mid") - spread * rules.width_low).withColumn("b_high", F.col("b_mid") + spread * rules.width_high)
    inside = (F.col("q_log_ppl") >= F.col("b_low")) & (F.col("q_log_ppl") <= F.col("b_high"))
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(inside, F.lit(True)))


def _released(held: list[Broadcast]) -> None:
    for b in held:
        b.destroy()


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept; then n_bytes, log_ppl
    and the band.

    A null or empty text has no words, no perplexity and fails the base rules; a long text is
    scored whole; a null language is a language of its own; equal texts of a language get equal
    verdicts, and a text on the band's edge is kept; no rows give no rows.  Extra columns of docs
    are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    plain = Rows(docs).select("doc_id", "text", "lang")
    held = blocks(probabilities(gram_counts(plain)), rules)
    rows = checkpointed(scored(plain, held, rules))
    _released(held)
    names = [x.split()[0] for x in _SCORED.split(", ")]
    shown = {f"q_{c}": c for c in (*names[:5], "base_failed", "kept", "n_bytes", "log_ppl")} | {"b_low": "band_low", "b_high": "band_high"}
    return _judged(rows, rules).select("doc_id", *(F.col(k).alias(v) for k, v in shown.items()))


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps."""
    tune(docs.sparkSession)
    own = Rows(docs)
    held = blocks(probabilities(gram_counts(own.select("text", "lang"))), rules)
    rows = written(scored(docs, held, rules, own), "quality")
    _released(held)
    return own.unpacked(_judged(rows, rules).filter("q_kept"))
