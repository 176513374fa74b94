import re

import pytest

from rivulet.llm import privacy as P

TEXT = "+1 (980) 555-6268 Inerha. Mail bosbt.99@mail9.example.com, Bosbt.99@Mail9.example.com. IP 48.167.189.142 and 10.1.2.3. Card 4512160218721939 or 4111-1111-1111-1111. Mr. John Smith met Mrs. Smith; Smith said. Frau Müller, Госпожа Иванова и Господин Иванов. 123-45-6789 end 1.2.3.4.5"


def rewritten(text, key=b"k", again=None):
    return P.rewrite(text, lambda k, c: (again or {}).get((k, c), 0), lambda k, c, a: P.surrogate(k, c, key, a))


def test_detection():
    found = [(TEXT[e.start : e.end], e.kind) for e in P.detect(TEXT)]
    assert found == [("+1 (980) 555-6268", "phone"), ("bosbt.99@mail9.example.com", "email"), ("Bosbt.99@Mail9.example.com", "email"), ("48.167.189.142", "ipv4"), ("10.1.2.3", "ipv4"), ("4512160218721939", "card"), ("4111-1111-1111-1111", "card"), ("John", "name"), ("Smith", "name"), ("Smith", "name"), ("Smith", "name"), ("Müller", "name"), ("Иванова", "name"), ("Иванов", "name"), ("123-45-6789", "ssn")]
    assert P.detect("call 12 or 1.2.3 at 10:30, @nobody, a@b, 999.1.1.1, page 2020-2021") == []


def test_surrogates_keep_type_format_and_coreference():
    new, counts = rewritten(TEXT)
    assert counts == [2, 2, 2, 1, 1, 7] and [e.kind for e in P.detect(new)] == [e.kind for e in P.detect(TEXT)]
    old = [TEXT[e.start : e.end] for e in P.detect(TEXT)]
    got = [new[e.start : e.end] for e in P.detect(new)]
    assert all(a != b for a, b in zip(old, got))
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) \d{3}-\d{4}", got[0]) and got[1].lower() == got[2].lower() and got[2][0].isupper()
    assert got[4].startswith("10.") and not got[3].startswith(("10.", "127.", "192.168."))
    assert got[5][0] == "4" and P._luhn(got[5]) == P._luhn(old[5]) and P._luhn(got[6].replace("-", "")) and re.fullmatch(r"\d{4}(-\d{4}){3}", got[6])
    assert got[8] == got[9] == got[10] != got[11] and got[12] == got[13] + "а"
    assert P._script(got[13]) == "cyrillic" and rewritten(TEXT) == (new, counts) != rewritten(TEXT, b"other")


def test_names_keep_gender():
    ends = {"m": P._NAME_PARTS["latin"][2]["m"], "f": P._NAME_PARTS["latin"][2]["f"]}
    for title, g in (("Mr", "m"), ("Mrs", "f")):
        for first in ("Alex", "Robin", "Sam", "Kim"):
            assert rewritten(f"{title} {first} Doe")[0].split()[1].endswith(ends[g])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_permutation_is_one(n):
    every = [[int(c) for c in f"{i:0{n}d}"] for i in range(10**n)]
    assert sorted(P.permute(x, 10, b"k", "t") for x in every) == every


def test_distinct_originals_stay_distinct():
    cards = {P.surrogate("card", f"4{i:012d}{c}", b"k") for i in range(300) for c in "05"}
    phones = {P.surrogate("phone", f"1:{2000000 + i}", b"k") for i in range(2000)}
    hosts = {P.surrogate("ipv4", f"8.8.{i // 256}.{i % 256}", b"k") for i in range(1000)}
    assert (len(cards), len(phones), len(hosts)) == (600, 2000, 1000)


def test_collisions_are_resolved(spark):
    """All 100 two-digit and 900 three-letter-name entities: surrogates must avoid real ones or move."""
    names = [("name", f"given:m:latin:n{i}") for i in range(600)]
    found = spark.createDataFrame(names, "kind string, canon string")
    again = {(r.kind, r.canon): r.attempt for r in P.exceptions(found, b"k").collect()}
    made = [P.surrogate(k, c, b"k", again.get((k, c), 0)) for k, c in names]
    first = [P.surrogate(k, c, b"k") for k, c in names]
    assert len(set(made)) == 600 and len(set(first)) < 600 and again


def by_hand(texts, key):
    """The whole table's result in plain Python: settle what nobody else shows, draw again otherwise."""
    entities = {(e.kind, e.canon) for t in texts if t for e in P.detect(t)}
    taken = {(k, x) for k, c in entities for x in P.shown(k, c)}
    attempt, turn = {}, dict.fromkeys(entities, 0)
    while turn:
        drawn = {(k, c): {(k, x) for x in P.shown(k, P.surrogate(k, c, key, a))} for (k, c), a in turn.items()}
        lost = {e for e, seen in drawn.items() if seen & taken or any(o[0] == e[0] and o[1] < e[1] and s & seen for o, s in drawn.items())}
        attempt |= {e: a for e, a in turn.items() if e not in lost}
        taken |= {x for e, seen in drawn.items() if e not in lost for x in seen}
        turn = {e: turn[e] + 1 for e in lost}
    return [None if t is None else P.rewrite(t, lambda k, c: attempt[k, c], lambda k, c, a: P.surrogate(k, c, key, a))[0] for t in texts]


@pytest.mark.parametrize("most", [200_000, -1])
def test_whole_table_by_hand(spark, docs, most):
    """Names of all roles, null ids and repeated rows, on the broadcast and on the joined path."""
    names = [f"{t} {a} {b} wrote." for t, a, b in zip(["Mr", "Mrs", "Dr", "Frau", "Ms"] * 60, (f"N{i}a" for i in range(300)), (f"N{i % 90}a" for i in range(300)))]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(None if i % 2 else 7, t) for i, t in enumerate(names)] + [(1, names[0]), (1, names[0])]
    want = sorted(zip((i for i, _ in rows), by_hand([t for _, t in rows], P.Privacy().key)), key=repr)
    found = P.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), P.Privacy(broadcast_exceptions=most)).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in found), key=repr) == want


@pytest.mark.parametrize("most", [200_000, -1])
def test_distinct_names_without_ids_stay_distinct(spark, most):
    df = spark.createDataFrame([(None, f"Mr Name{'abcdefghijklmnopqrstuvwxyz'[i // 26 % 26]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 676]}") for i in range(1600)], "doc_id long, text string")
    found = {r.text for r in P.surrogates(df, P.Privacy(broadcast_exceptions=most)).collect()}
    assert len(found) == 1600


def test_surrogates_aren_t_names_of_the_corpus(spark):
    """Whatever role the shown word has there."""
    first = P.rewrite("Mr John", lambda k, c: 0, lambda k, c, a: P.surrogate(k, c, P.Privacy().key, a))[0].split()[1]
    df = spark.createDataFrame([(1, "Mr John"), (2, f"Mrs Anna {first}")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in P.surrogates(df).collect()}
    assert first not in found[1] and first not in found[2]


@pytest.mark.parametrize("number", ["+15551234567", "+1 5551234567", "+33 6 12 34 56 78", "06 12 34 56 78", "+34 612 34 56 78", "+49 30 1234567", "+1 (980) 555-6268"])
def test_phone_forms(number):
    found = P.detect(f"so {number} it is")
    assert [f"so {number} it is"[e.start : e.end] for e in found] == [number] and found[0].kind == "phone"
    new = rewritten(f"so {number} it is")[0]
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", f"so {number} it is") and number not in new
    assert [e.kind for e in P.detect("Tel: 5551234567")] == ["phone"] and not P.detect("item 5551234567")


def test_no_mail_stays(docs):
    df = docs.select("doc_id", "text")
    found = {r.doc_id: r.text for r in P.surrogates(df).collect()}
    mails = [m for r in df.collect() for m in re.findall(r"\S+@\S+", r.text or "")]
    assert mails and not any(m in t for m in mails for t in found.values() if t)


def test_odd_rows(odd, none):
    rows = P.surrogates(odd).collect()
    assert sorted((r.doc_id or -1, r.text) for r in rows if r.doc_id in (1, 2, 4)) == [] or {(r.doc_id, r.text) for r in rows if r.doc_id in (1, 2, 4)} == {(1, None), (2, ""), (4, "one")}
    assert len(rows) == 9 and P.surrogates(none).count() == 0 and P.rewritten(odd).columns == odd.columns
