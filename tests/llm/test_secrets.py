import hashlib
import math
import random
import re

import numpy as np

from rivulet.llm import secrets as S

ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) + ("_?[Kk][Ee][Yy]" if k == "api" else "") for k in ("password", "passwd", "secret", "token", "api")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
RULES = (("assign", ASSIGN, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))


def base(text):
    out = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, rx, ok) in enumerate(RULES) for m in rx.finditer(text or "") if ok(m))
    return [sum(x[1] == i for x in out) for i in range(3)] + [hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest()]


TEXTS = ["", "é token = \"29c8d525dd5c99f9\" ü AKIAIOSFODNN7ABCDEF", "secret: token=abcdefghijkl", "PASSWORD='short' passwd : long.enough.value", "ſecret=abcdefghijklmnop api_key=ABCDEFGHIJKL apikey:0123456789abcdef0", "漢" * 5 + "deadbeefdeadbeefdead"]


def test_base_rules_by_brute_force(spark, docs, odd):
    own = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for df in (docs, odd, own):
        want = sorted(([r.doc_id, *base(r.text)] for r in df.select("doc_id", "text").collect()), key=repr)
        got = sorted(([r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256] for r in S.secrets(df).collect()), key=repr)
        assert got == want


def test_entropy_by_brute_force():
    rng = random.Random(3)
    for chars, bits in (("0123456789abcdef", 3.0), ("abc123XYZ", 2.9)):
        for _ in range(100):
            run = "".join(rng.choice(chars) for _ in range(rng.randrange(15, 70))).encode()
            on = set()
            for i in range(len(run) - 19):
                w = run[i : i + 20]
                h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
                if h >= bits - 1e-9 and any(48 <= c < 58 for c in w) and any(c >= 65 for c in w):
                    on.update(range(i, i + 20))
            assert {x for lo, hi in S.entropy_windows(run, 20, bits) for x in range(lo, hi)} == on


def spans(text):
    t = np.frombuffer(text.encode(), np.uint8)
    return [x.split(":")[0] for x in S._shown(S.entropy_spans(t), t).split(",") if x]


def test_entropy_finds_keys_and_allows_known_shapes():
    assert spans("key Zk3vQ9xLmT7bRw2sYp8dHf4g end") == ["entropy_alnum"] and spans("k A7+fZ/q9LmWx2_Tb-Rs8Yp0Dh= x") == ["entropy_base64"]
    assert spans("x 9F86D081884C7D659A2FEAA0C55AD015") == ["entropy_hex"]
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "https://x.org/Zk3vQ9xLmT7bRw2sYp8dHf4g", "sha256:9F86D081884C7D659A2FEAA0C55AD015", "Donaudampfschifffahrtsgesellschaft", "4111111111111111111111111", "EXAMPLEZk3vQ9xLmT7bRw2sYp", "a" * 40 + "1"):
        assert spans(f"see {fine} end") == [], fine


def test_odd_rows(odd, none):
    assert S.secrets(odd).count() == 9 and S.secrets(none).count() == 0


def test_glued_values_are_judged_by_their_own_class():
    rng = random.Random(5)
    for before, after in (("", ""), ("K=", ""), ("NAME_OF_IT=", ""), ("path/to/", ""), ("id_", ""), ("x-", "/tail"), ("A=b&k=", "=z")):
        for chars in ("0123456789ABCDEF", "0123456789abcdefABCDEF"):
            values = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(50)]
            assert sum(bool(spans(f"see {before}{v}{after} end")) for v in values) >= 49, (before, chars)
    two = "K=9F86D081884C7D659A2FEAA0C55AD015/A7C3E9015BD2468F0E1D2C3B4A596877"
    t = np.frombuffer(two.encode(), np.uint8)
    assert {x for s, _, e in S.entropy_spans(t) for x in range(s, e)} >= {*range(2, 34), *range(35, 67)}
    for fine in ("x/sha1=9F86D081884C7D659A2FEAA0C55AD015", "x/md5_9F86D081884C7D659A2FEAA0C55AD015", "id=123e4567-e89b-12d3-a456-426614174000"):
        assert spans(f"see {fine} end") == [], fine


def test_url_paths_are_allowed_and_queries_searched():
    key = "Zk3vQ9xLmT7bRw2sYp8dHf4g"
    for fine in (f"https://x.org/{'a-b/' * 400}{key}", f"commit      {key}", f"sha256: {key}"):
        assert spans(f"see {fine} end") == [], fine
    for bad in (f"https://x.org/p?access_key={key}", f"https://x.org/{'a-b/' * 400}p?k={key}&z=1", f"https://x.org/#{key}", f"example.com,{key}", f"2024-01-02:{key}"):
        assert len(spans(f"see {bad} end")) == 1, bad
    run = "example/" + key
    t = np.frombuffer(run.encode(), np.uint8)
    (lo, _, hi), = S.entropy_spans(t)
    assert lo >= 7 and hi == len(run)  # the rest of a run with a placeholder is still searched


def labelled(seed=11, n=400):
    """Lines with a secret that no base rule names, and lines with what only looks like one."""
    rng = random.Random(seed)
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum, word = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789", lambda: draw("abdeilmnorstu", rng.randrange(3, 9))
    bad = [lambda: f"Authorization: Bearer {draw(alnum, 36)}", lambda: f"AUTH={draw(alnum + '+/', 40)}", lambda: f"https://h.org/v1?key={draw(alnum, 32)}", lambda: f"{draw('0123456789ABCDEF', 40)}", lambda: f"gh_{draw(alnum, 36)}"]
    hexes = lambda k: draw("0123456789ABCDEF", k)
    fine = [lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"https://h.org/{draw(alnum, 32)}", lambda: f"sha256:{hexes(64)}", lambda: "2024-01-02T03-04-05_06", lambda: "".join(word().capitalize() for _ in range(5)) + str(rng.randrange(100)), lambda: draw("0123456789", 24), lambda: "_".join(word() for _ in range(6))]
    line = lambda x: f"{word()} {word()} {x} {word()}"
    return [line(rng.choice(bad)()) for _ in range(n)], [line(rng.choice(fine)()) for _ in range(n)]


def test_the_method_adds_spans_on_labelled_lines():
    bad, fine = labelled()
    bad = [x for x in bad if not S.base_spans(np.frombuffer(x.encode(), np.uint8))]
    assert len(bad) > 350
    assert sum(bool(spans(x)) for x in bad) >= 0.95 * len(bad) and sum(bool(spans(x)) for x in fine) <= 0.05 * len(fine)
