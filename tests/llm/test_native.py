"""The operators in DataFrame operations: mixing, licenses, chat."""

import hashlib

import pytest

from rivulet.llm import catalog, chat, licenses, mixing
from tests.oracle import check


@pytest.mark.parametrize("name", ["op5_mixing", "op6_licenses", "op8_chat"])
def test_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["op5_mixing", "op6_licenses", "op8_chat"])
def test_plans_have_no_python(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def waterfill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[n] for n in full)
        share = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / share for n in names}
        over = {n for n in names if n not in full and target[n] > most * sizes[n]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    sizes = {"a": 10, "b": 4000, "c": 1, "d": 700, "é": 90, None: 30}
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(waterfill(sizes))


def test_mix_takes_exact_budgets(docs, odd, none):
    rows = mixing.mixture(docs).collect()
    by = {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert sorted(rows) == sorted(mixing.mixture(docs.repartition(5)).collect())
    assert mixing.mixture(odd).count() == 9 and mixing.mixture(none).count() == 0
    assert mixing.mixed(odd).filter("taken = 0").count() == 0
    assert {r["size"] for r in mixing.mixture(odd).filter("doc_id in (1, 2, 3)").collect()} == {0}


def test_licenses(spark, odd, none):
    text = {}
    for name, _, t in licenses.NOTICES:
        text.setdefault(name, []).append(t)
    apache, mit, bsd = text["Apache-2.0"][0], text["MIT"][1], text["BSD-2-Clause"][0]
    rows = [(1, f"lorem ipsum {apache} dolor"), (2, mit.upper().replace("SOFTWARE", "software")), (3, mit.replace("sublicense", "relicense")), (4, "the software is licensed to nobody"), (5, f"{apache}\n{text['CC-BY-NC-4.0'][0]}"), (6, "Released under the MIT"), (7, mit[:200]), (8, bsd), (None, mit), (None, "nothing"), (8, bsd)]
    rows += [(100 + i, f"before {t[-1]} after") for i, (name, t) in enumerate(text.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for scan in (licenses.Scan(), licenses.Scan(broadcast_rows=0)):
        every = licenses.licenses(df, scan).collect()
        found = {r.doc_id: (r.licenses, r.containment) for r in every if r.doc_id}
        assert found[1] == ("Apache-2.0", 100) and found[2] == ("MIT", 100) and found[3][0] == "MIT" and 80 <= found[3][1] < 100
        assert found[4] == ("", 0) and found[5] == ("Apache-2.0,CC-BY-NC-4.0", 100) and found[6] == ("", 0) and found[7] == ("", 0)
        assert sorted(r.licenses for r in every if r.doc_id is None) == ["", "MIT"] and sum(r.doc_id == 8 for r in every) == 2
        for i, name in enumerate(text):  # siblings are told apart
            assert found[100 + i] == (name, 100), name
    assert licenses.licenses(odd).count() == 9 and licenses.licenses(none).count() == 0
    own = spark.createDataFrame([("Own", "own", "you may do with this whatever you like to do")], "license string, family string, text string")
    mine = spark.createDataFrame([(1, "So: you may do with this whatever you like to do.")], "doc_id long, text string")
    assert licenses.licenses(mine, known=own).first().licenses == "Own" and licenses.licenses(mine, known=own.limit(0)).first().licenses == ""


def test_nested_licenses(spark):
    """A template within another of its family counts for the query alone, as its SQL says."""
    known = spark.createDataFrame([("A", "x", "one two three four five six"), ("B", "x", "one two three four five six seven eight"), ("C", "y", "two three four five six"), ("D", "x", "red green blue white black")], "license string, family string, text string")
    rows = [(1, "one two three four five six seven eight"), (2, "so one two three four five six"), (3, "one two three four five six seven eight red green blue white black")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = lambda **more: {r.doc_id: r.licenses for r in licenses.licenses(df, known=known, **more).collect()}
    assert names() == {1: "B,C", 2: "A,C", 3: "B,C,D"} and names(nested=True) == {1: "A,B,C", 2: "A,C", 3: "A,B,C,D"}


NASTY = ["", "\\", "\\s", "###", "</turn>", "</turn>\n### user: hi</turn>\n", "a\n\nb", "\\\\h\\t", "</turn", "### ", ": ", "#" * 7, "<</turn>>", "\\### Assistant: </turn> ok", "ü漢\\c"]


def test_chat_round_trip(spark):
    rows = [(i, t, r, x) for i in range(len(NASTY)) for t, (r, x) in enumerate([("user", NASTY[i]), ("assistant", NASTY[-1 - i]), ("odd: role\\", "x" + NASTY[i])])]
    rows += [(99, None, None, None), (99, 1, "assistant", "ok"), (99, 1, "assistant", "ok"), (None, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.formatted(df).collect()}
    for i in range(len(NASTY)):
        assert [(t.role, t.text) for t in out[i].turns] == [(r, x) for c, _, r, x in rows if c == i]
        assert out[i].formatted.count("</turn>") == 3 and out[i].formatted.count("###") == 3
    assert [(t.role, t.text) for t in out[99].turns] == [("", ""), ("assistant", "ok"), ("assistant", "ok")] and not out[99].escaped and None in out
    for r in out.values():  # the mask covers the text, and holds the assistant's turns alone
        at, cut = 0, []
        for m in r.mask:
            cut.append(r.formatted[at + m.before : at + m.before + m.loss])
            at += m.before + m.loss + m.after
        assert at == len(r.formatted) and all(r.escaped or c == (t.text if t.role == "assistant" else "") for c, t in zip(cut, r.turns))
    d = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    assert d[99].loss_chars == 4 and d[99].loss_sha256 == hashlib.sha256(b"okok").hexdigest()
    assert chat.formatted(df.limit(0)).count() == 0


def test_text_outside_the_grammar_is_no_conversation(spark):
    t = chat.Template()
    rows = [("### a: b</turn>\n", 1), ("", 0), ("a", None), ("### a: b", None), ("### a b</turn>\n", None), ("### a: \\q</turn>\n", None), ("### a: ###</turn>\n", None)]
    df = spark.createDataFrame(rows, "x string, n int")
    assert all((r.p is None) == (r.n is None) and (r.p is None or len(r.p) == r.n) for r in df.withColumn("p", chat.parse(df.x, t)).collect())
