import hashlib
import random
import re

import numpy as np
import pytest

from rivulet.llm import catalog, decontam
from tests.oracle import check

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        k = min(13, len(x))
        wins = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
        for p in range(len(w) - k + 1) if k else ():
            if tuple(w[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("win", [decontam.Winnow(), decontam.Winnow(bloom_bits=1 << 16, broadcast_rows=0)])
def test_by_brute_force(spark, win):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(6)] + ["Ünï", "x1"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(12)] + [(50, None), (51, " .,"), (9, items_text := "A b-c. D e f g h i j k l M n o p")]
    rows = [(i, " ".join([item(rng.randrange(30)), (rng.choice(items)[1] or "") if i % 2 else "", item(rng.randrange(400))])) for i in range(60)] + [(100, None), (101, ""), (102, items_text.upper() + " tail"), (102, items_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs, bench, win)
    assert result(found) == sorted(((i, *brute(t, [x for x in items if x[1] is not None])) for i, t in rows), key=repr)
    kept = decontam.drop_contaminated(docs, bench, win)
    assert kept.count() == found.filter("not contaminated").count()


def test_every_long_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 50, 9).astype(np.uint64)
        a, b = (np.r_[rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64)] for _ in range(2))
        assert set(a[decontam.fingerprints(a, 9)]) & set(b[decontam.fingerprints(b, 9)])


def test_odd_rows(spark, odd, none, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.contamination(odd, bench).count() == 9 and decontam.contamination(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == 9
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns


def test_matches_sql(spark, sf_dir):
    check(spark, sf_dir, catalog.QUERIES["op4_winnowing"], catalog.ORACLES["op4_winnowing"])
