import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rivulet.llm import perplexity as Q
from rivulet.llm.hasharray import HashArray


def base(text):
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    w = [x for _, x in words]
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0
    return len(w), sum(map(len, w)), symbols, lines, len(covered)


def test_base_counts_by_brute_force(docs, odd):
    for df in (docs, odd):
        rows = Q.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        want = sorted(((r.doc_id, *base(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted((tuple(r[:6]) for r in rows), key=repr) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)


def test_only_short_blank_or_odd_rows_fail(odd, none, docs):
    found = Q.quality(odd)
    assert found.count() == 9 and not found.filter("base_failed and kept").count()
    assert Q.quality(none).count() == 0 and Q.keep_clean(none).columns == none.columns
    assert Q.quality(docs).filter("kept").count() > 0.75 * docs.count()


def test_model_by_brute_force(spark):
    """Interpolated modified Kneser-Ney over padded bytes, without hashing."""
    texts = ["the cat sat", "the cat ran", "a dog sat on the cat", "the dog", "cats and dogs and cats"] * 2
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = {r.gram: r.v for r in Q.probabilities(Q.gram_counts(df)).collect()}
    raw = Counter()
    for t in texts:
        b = b"\x02" * 4 + t.encode()
        raw.update(b[i - 4 : i + 1] for i in range(4, len(b)))
    levels = {5: raw}
    for n in range(4, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discount(n):
        k = Counter(levels[n].values())
        if all(k[i] for i in (1, 2, 3, 4)):
            y = k[1] / (k[1] + 2 * k[2])
            d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        else:
            d = [0.5, 0.75, 0.9]
        return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    totals = {n: defaultdict(list) for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            totals[n][g[:-1]].append(v)
    ds = {n: discount(n) for n in levels}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        own = totals[n].get(g[:-1])
        if not own:
            return p(g[1:])
        c = levels[n].get(g, 0)
        d = lambda v: ds[n][min(v, 3) - 1]
        return (max(c - d(c), 0) if c else 0) / sum(own) + sum(map(d, own)) / sum(own) * p(g[1:])

    tag = Q.lang_tag("en")
    key = lambda g: int(np.uint64(int.from_bytes(g, "big") | tag << 40).view(np.int64))
    assert len(table) == len(raw)
    for g in raw:
        assert 10 ** table[key(g)] == pytest.approx(p(g), rel=1e-4)
    assert sum(p(b"e ca" + bytes([x])) for x in range(256)) == pytest.approx(1, abs=1e-9)


def test_noise_is_rejected(spark, docs):
    rng = np.random.default_rng(0)
    noise = [(10**6 + i, " ".join("".join(chr(c) for c in rng.integers(33, 126, 9)) for _ in range(200)), "en") for i in range(5)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    assert Q.quality(both).filter("doc_id >= 1000000 and kept").count() == 0


def test_hash_array():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    table = HashArray(keys, np.arange(len(keys), dtype=np.float32))
    ok, value = table.get(keys[::-1])
    assert ok.all() and (value == np.arange(len(keys))[::-1]).all()
    assert not table.get(np.array([1, 2**64 - 1], np.uint64))[0].any()
    assert not HashArray(np.zeros(0, np.uint64), np.zeros(0, np.float32)).get(keys[:3])[0].any()


def test_bands_are_symmetric_in_their_spread(docs):
    row = Q.quality(docs).filter("not base_failed").first()
    assert row.band_low < row.band_high and math.isfinite(row.log_ppl)


def test_no_ngram_is_left_out(docs):
    """Verdicts don't depend on the bound on what a task holds."""
    counts = Q.gram_counts(docs.select("text", "lang"))
    n = Q.probabilities(counts).count()
    assert n == counts.filter("n = 5").count()
    names = ("doc_id", "kept", "log_ppl")
    want = {r.doc_id: (r.kept, r.log_ppl) for r in Q.quality(docs).select(*names).collect()}
    got = {r.doc_id: (r.kept, r.log_ppl) for r in Q.quality(docs, Q.Rules(block_entries=n // 5)).select(*names).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_bands_reject_labelled_junk(spark, sf_dir):
    """Of what passes the base rules: at least two fifths of the junk go, and at most 2 % of the clean."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{x}.parquet") for x in ("documents", "labels"))
    rows = Q.quality(docs).join(labels, "doc_id").filter("not base_failed").select("quality", "kept").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) > 20 and 1 - sum(junk) / len(junk) >= 0.4
    assert len(clean) > 300 and 1 - sum(clean) / len(clean) <= 0.02
