import random
import re
from itertools import combinations

import pytest

from rivulet.llm import dedup as D
from rivulet.llm.graph import components


def sets(rows, k=2):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute(rows, percent=80):
    s = sets(rows)
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(s, 2):
        common = len(s[a] & s[b])
        if common and 100 * common >= percent * len(s[a] | s[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in s}


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert found == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(docs).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize(("rounds", "block"), [(0, 400_000), (1, 3000), (2, 1)])
def test_large_group_of_near_copies(spark, rounds, block):
    rng = random.Random(5)
    stem = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(stem)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, "Stem " * 3 + f"alone {i} one two three") for i in range(100, 130)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), D.Banding(pivot_rounds=rounds, pairs_a_row=0.1, block_shingles=block)).collect()}
    assert found == brute(rows)


def test_odd_rows(odd, none):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in D.near_duplicates(odd).collect()}
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True) and found[4] == (1, 4, True) and None not in found and len(found) == 7
    kept = D.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8]
    assert D.near_duplicates(none).count() == 0 and D.keep_one(none).count() == 0


def test_exact_copies_keep_the_smallest(spark):
    df = spark.createDataFrame([(9, "Some words here now"), (3, "some  words\nhere now"), (7, "SOME words here NOW"), (1, "x")], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.keep_one(df).collect()) == [1, 3]
    assert sorted(r.doc_id for r in D.keep_one(df.repartition(3), D.Banding(broadcast_ids=0)).collect()) == [1, 3]


def test_recall_of_the_bands():
    """The share of pairs at the threshold that some table holds."""
    import numpy as np

    band, rng = D.Banding(), np.random.default_rng(3)
    factors, hit = D._multipliers(2 * band.halves * band.rows), 0
    for _ in range(300):
        common, own = rng.integers(0, 2**63, 80, dtype=np.int64), rng.integers(0, 2**63, 20, dtype=np.int64)
        a, b = (np.unique(np.r_[common, x]).astype(np.uint64) for x in (own[:10], own[10:]))
        x, y = D.half_keys(a, factors, band), D.half_keys(b, factors, band)
        m = band.halves
        hit += bool((x[:m] == y[:m]).any() and (x[m:] == y[m:]).any())
    assert hit >= 295
