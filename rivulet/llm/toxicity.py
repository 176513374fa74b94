"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

A text is folded to letters and one boundary sign for each gap between words; other signs drop
out, so characters that are put between the letters of an insult go or become gaps.  Windows of
``width`` letters are compared by the gap-weighted subsequence kernel

    k(s, t) = sum over u of f_u(s) f_u(t),   f_u(s) = sum over occurrences of u in s of decay^span

over all letter sequences u of length 4 that span at most ``reach`` letters.  The Nyström map is
phi(s) = K_mm^(-1/2) (k(s, l_1), ..., k(s, l_m)) with landmark windows l_1, ..., l_m, and a linear
support vector machine is trained on it.  Its decision w . phi(s) is a sum over the landmarks and
so over the sequences u: the machine folds into one weight for each u, and a text of any length is
scored in linear time.  A text's score is that of its worst window, through a logistic curve.

Texts have two views, each with a machine of its own: one of letters without their marks, and one
in which marked Latin letters are signs of their own, as marks tell some words apart.  The logistic
curve is over both decisions.

Labels belong to whole texts, so the training windows of toxic texts are their worst ones under
the machine so far, which begins with the windows' log odds (multiple-instance learning).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.runtime import buffers, columns, crc_mod, texts, tune, written

BITS = 5
GRAM = 4
SPACE = 31
#: Flag of a Latin letter with marks; the two bits above it say which of four signs it is with them.
MARK = 32


@dataclass(frozen=True)
class Svm:
    """Production parameters.  ``sample`` and ``sample_bytes`` bound what the classifier is fitted on."""

    sample: int = 12_000
    #: Bytes of folded text of these rows, in the sample's order; the driver holds them.
    sample_bytes: int = 48 << 20
    width: int = 10
    reach: int = 6
    decay: float = 0.7
    landmarks: int = 384
    rounds: int = 4
    c: float = 4.0
    seed: int = 5
    held_out: int = 2
    modulus: int = 4
    threshold: float = 0.3


def _fold_table() -> np.ndarray:
    """Code point to letter 1-30, boundary 31, or 0 for signs that drop out; with MARK and its bits.

    Digits and signs that stand for letters count as these, and letters with marks as their base,
    but for Cyrillic ones with a breve, which are letters of their own.
    Letters of other scripts are dealt to 30 signs by their code point, so that those of one
    alphabet differ; upper and lower case are one.
    """
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "Z":
            out[cp] = SPACE
        elif kind[0] == "L":
            parts = unicodedata.normalize("NFKD", c.lower()[0])
            base = ord(c.lower()[0] if "\u0306" in parts and 0x400 <= ord(parts[0]) < 0x530 else parts[0])
            out[cp] = base - 0x60 if 0x61 <= base <= 0x7A else 1 + base % 30
            if 0x61 <= base <= 0x7A and len(parts) > 1:
                out[cp] |= MARK | ord(c.lower()[0]) % 4 << 6
    for c in range(26):
        out[0x41 + c] = out[0x61 + c] = c + 1
    for sign, letter in zip(b"013457@$!", b"oieastasi"):
        out[sign] = letter - 0x60
    for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        out[c] = SPACE
    return out


_FOLD = _fold_table()


def marked(text: np.ndarray) -> np.ndarray:
    """The letters of a text, with what tells of their marks, and a boundary before, between and
    after words."""
    if len(text) and text.max() >= 0x80:
        points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        signs = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 1 + points % 30).astype(np.uint8)
    else:
        signs = _FOLD[text]
    signs = signs[signs > 0]
    signs = np.concatenate([[SPACE], signs, [SPACE]]).astype(np.uint8)
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != SPACE) | (signs[:-1] != SPACE)
    return signs[keep]


def folded(text: np.ndarray) -> np.ndarray:
    """The letters of a text without their marks."""
    return VIEWS[0](marked(text))


#: From marked()'s signs to those of the machines.
VIEWS = (lambda signs: signs & SPACE, lambda signs: np.where(signs & MARK, 27 + (signs >> 6), signs & SPACE).astype(np.uint8))


def patterns(svm: Svm) -> list[tuple[tuple[int, ...], float]]:
    """Offsets of a sequence's letters, and their weight."""
    return [((0, *rest), svm.decay ** (rest[-1] + 1 - GRAM)) for rest in combinations(range(1, svm.reach), GRAM - 1)]


def _codes(signs: np.ndarray, offsets: tuple[int, ...], n: int) -> np.ndarray:
    code = np.zeros(n, np.int32)
    for d in offsets:
        code = (code << BITS) | signs[d : d + n]
    return code


def position_scores(signs: np.ndarray, beta: np.ndarray, svm: Svm) -> np.ndarray:
    """The weighted sum over the sequences that begin at each letter; signs end with a pad."""
    n = len(signs) - svm.reach + 1
    if n <= 0:
        return np.zeros(0)
    wide = signs.astype(np.int32)
    pair = {d: (wide[: len(wide) - d] << BITS) | wide[d:] for d in range(1, svm.reach)}
    out = np.zeros(n, np.float32)
    for (_, a, b, c), weight in patterns(svm):
        out += beta[(pair[a][:n] << (2 * BITS)) | pair[c - b][b : b + n]] * np.float32(weight)
    return out


def window_scores(signs: np.ndarray, beta: np.ndarray, svm: Svm) -> np.ndarray:
    """The machine's decision for the window that begins at each letter."""
    at = np.concatenate([[0.0], np.cumsum(position_scores(signs, beta, svm), dtype=np.float64)])
    span = svm.width - svm.reach + 1
    return at[span:] - at[:-span] if len(at) > span else np.zeros(0)


def _pad(svm: Svm) -> np.ndarray:
    return np.full(svm.width, SPACE, np.uint8)


def worst_windows(rows: list[np.ndarray], beta: np.ndarray, svm: Svm, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Each folded text's highest decision, and where that window begins.

    Texts are scored together up to so many letters at a time, which bounds the memory.
    """
    pad = _pad(svm)
    best, where = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size + len(rows[hi]) <= most):
            size += len(rows[hi])
            hi += 1
        scores = window_scores(np.concatenate([x for r in rows[lo:hi] for x in (r, pad)]), beta, svm)
        at = 0
        for i in range(lo, hi):
            own = scores[at : at + max(1, len(rows[i]))]
            where[i] = int(own.argmax())
            best[i] = own[where[i]]
            at += len(rows[i]) + len(pad)
        lo = hi
    return best, where


def _features(windows: np.ndarray, svm: Svm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sequences and weights of windows, one row each."""
    n = svm.width - svm.reach + 1
    codes, weights = [], []
    for offsets, weight in patterns(svm):
        code = np.zeros((len(windows), n), np.int32)
        for d in offsets:
            code = (code << BITS) | windows[:, d : d + n]
        codes.append(code)
        weights.append(np.full(code.shape, weight))
    code, weight = np.concatenate(codes, 1), np.concatenate(weights, 1)
    return np.repeat(np.arange(len(windows)), code.shape[1]), code.ravel(), weight.ravel()


def _kernel(windows: np.ndarray, marks: np.ndarray, svm: Svm) -> np.ndarray:
    """k(window, landmark), by spreading the landmarks' features over a dense table of those used."""
    mr, mc, mw = _features(marks, svm)
    used, mc = np.unique(mc, return_inverse=True)
    table = np.zeros((len(used) + 1, len(marks)), np.float32)  # the last row is that of unknown sequences
    np.add.at(table, (mc, mr), mw)
    out = np.zeros((len(windows), len(marks)), np.float32)
    for lo in range(0, len(windows), 256):
        part = windows[lo : lo + 256]
        _, c, w = _features(part, svm)
        at = np.searchsorted(used, c)
        at[(at == len(used)) | (used[np.minimum(at, len(used) - 1)] != c)] = len(used)
        out[lo : lo + 256] = (table[at] * w[:, None].astype(np.float32)).reshape(len(part), -1, len(marks)).sum(1)
    return out


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rng: np.random.Generator, epochs: int = 25) -> tuple[np.ndarray, float]:
    """Hinge-loss SVM by dual coordinate descent; the last feature is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    square, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


@dataclass
class Machine:
    beta: np.ndarray
    slope: float
    offset: float

    def chance(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -40, 40)))


@dataclass
class Pair:
    """A machine for each view, and the logistic curve over their decisions."""

    machines: list[Machine]
    slopes: np.ndarray
    offset: float

    def chance(self, rows: list[np.ndarray], svm: Svm) -> np.ndarray:
        """rows: marked()'s signs."""
        best = sum(slope * worst_windows([view(r) for r in rows], m.beta, svm)[0] for view, m, slope in zip(VIEWS, self.machines, self.slopes))
        return Machine(self.machines[0].beta, 1.0, self.offset).chance(best)


def train_views(rows: list[np.ndarray], toxic: np.ndarray, svm: Svm = Svm()) -> Pair:
    """From marked()'s signs of texts and their labels."""
    machines, best = [], np.zeros((len(VIEWS), len(rows)))
    for i, view in enumerate(VIEWS):
        own = [view(r) for r in rows]
        machines.append(train(own, toxic, svm))
        best[i] = worst_windows(own, machines[i].beta, svm)[0]
    if not len(rows) or toxic.all() or not toxic.any():
        return Pair(machines, np.ones(len(VIEWS)), machines[0].offset)
    return Pair(machines, *_logistic(best, toxic.astype(float)))


def train(rows: list[np.ndarray], toxic: np.ndarray, svm: Svm = Svm()) -> Machine:
    """A machine from folded texts and their labels."""
    rng = np.random.Generator(np.random.PCG64(svm.seed))
    size = 1 << BITS * GRAM
    beta = np.zeros(size, np.float32)
    if not len(rows) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(rows) else 0.0
        return Machine(beta, 1.0, float(np.log((share + 0.01) / (1.01 - share))))
    seen = np.zeros((2, size))
    for r, t in zip(rows, toxic.astype(int)):
        if len(r) >= GRAM:
            seen[t, np.unique(_codes(r, tuple(range(GRAM)), len(r) - GRAM + 1))] += 1
    total = np.bincount(toxic.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.1) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    beta = np.where((seen[1] >= 4) & (odds > 1.0), odds, 0).astype(np.float32)
    pad = _pad(svm)
    cut = lambda i, at: np.concatenate([rows[i][at : at + svm.width], pad])[: svm.width]
    yes, no = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    hard: list[np.ndarray] = []
    for _ in range(svm.rounds):
        best, where = worst_windows(rows, beta, svm)
        positive = [cut(i, where[i]) for i in yes if best[i] > 0]
        top = no[np.argsort(-best[no])][:1500]
        hard = (hard + [cut(i, where[i]) for i in top])[-4500:]
        plain = [cut(i, int(rng.integers(0, len(rows[i])))) for i in rng.choice(no, min(len(no), 1000), replace=False)]
        if not positive:
            break
        windows = np.array(positive + hard + plain)
        y = np.r_[np.ones(len(positive)), -np.ones(len(hard) + len(plain))]
        marks = np.unique(windows[np.r_[rng.permutation(len(positive))[: svm.landmarks * 2 // 3], len(positive) + rng.permutation(len(hard) + len(plain))[: svm.landmarks // 3]]], axis=0)
        k_mm = _kernel(marks, marks, svm).astype(float)
        values, vectors = np.linalg.eigh(k_mm)
        ok = values > 1e-6 * values[-1]
        root = vectors[:, ok] / np.sqrt(values[ok])
        x = _kernel(windows, marks, svm) @ root
        scale = np.sqrt((x * x).sum(1).mean())
        cost = np.where(y > 0, svm.c * max(1.0, (y < 0).sum() / max(1, (y > 0).sum()) / 4), svm.c)
        w, _ = _linear_svm(x / scale, y, cost, rng)
        alpha = root @ (w / scale)
        mr, mc, mw = _features(marks, svm)
        beta = np.bincount(mc, alpha[mr] * mw, minlength=size).astype(np.float32)
    best, _ = worst_windows(rows, beta, svm)
    slopes, offset = _logistic(best[None], toxic.astype(float))
    return Machine(beta, float(slopes[0]), offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic curve that rises with each row of x, by Newton's method with a weak prior."""
    center, scale = x.mean(1), x.std(1) + 1e-9
    z = np.vstack([(x - center[:, None]) / scale[:, None], np.ones(x.shape[1])]).T
    w = np.zeros(len(x) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w)
    slopes = np.maximum(w[:-1] / scale, 1e-6)
    return slopes, float(w[-1] - w[:-1] @ (center / scale))


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [marked(t).tobytes() for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary()), pa.array([len(x) for x in rows], pa.int64())], ["doc_id", "toxic", "signs", "n"])


def fit(docs: DataFrame, labels: DataFrame, svm: Svm = Svm()) -> Pair:
    """Fitted on at most ``sample`` labelled documents that aren't held out, taken by hash, as far as
    they fit ``sample_bytes``.  Of a doc_id's repeated rows the smallest text counts."""
    known = columns(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(crc_mod(F.col("doc_id"), svm.modulus) != svm.held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(svm.sample)
    rows = columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(rows.mapInArrow(_folds, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, signs binary, n long"), "sample")
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    own = rows.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= svm.sample_bytes).select("doc_id")
    held = rows.join(F.broadcast(own), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("signs", "toxic").toArrow()
    return train_views([np.frombuffer(x.as_buffer(), np.uint8) for x in held.column("signs")], np.array(held.column("toxic").to_pylist(), int) > 0, svm)


def toxicity(docs: DataFrame, labels: DataFrame, svm: Svm = Svm()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only the text goes into a score.  Null and empty texts have the score of a text without any
    window of weight; a long text that of its worst window.  Without labels of both kinds every text
    gets the share of toxic ones.  Repeated rows get equal scores; repeated labels count by their
    maximum; a score at the threshold is predicted toxic; no rows give no rows.  Extra columns are
    ignored, whatever their names.
    """
    tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, svm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch in batches:
            data, at = buffers(batch.column("text"))
            score = machine.chance([marked(data[lo:hi]) for lo, hi in zip(at[:-1], at[1:])], svm)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= svm.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = columns(docs, "doc_id", "text").select("doc_id", (crc_mod(F.col("doc_id"), svm.modulus) == svm.held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
