"""Surrogate generation for personal data.

Detected entities are replaced by keyed surrogates of the same type and format: phone numbers keep
country code and layout, cards their first digit and their (in)valid check digit, addresses their
kind of network, e-mail addresses the pattern of letters and digits, names gender and script.

Digits, letters and addresses go through a keyed Feistel permutation of all strings of their
format, so different originals get different surrogates and equal originals equal ones wherever
they occur.  Names have no such finite format; they are made of syllables drawn by a keyed hash.
All distinct entities of the corpus are then checked by what a reader sees: for names the word in
its script, whatever its role or gender.  An entity whose surrogate is shown by the corpus itself,
by a settled entity or by a smaller one that is drawing too draws again; the others are settled.
The few that drew again are exceptions which the rewriting pass gets, broadcast if they are few
and joined by the text's digest if not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.runtime import Rows, checkpointed, few, tune, written

KINDS = ("email", "ipv4", "card", "ssn", "phone", "name")


@dataclass(frozen=True)
class Privacy:
    """Production parameters.  The key must be kept secret; equal keys give equal surrogates."""

    key: bytes = b"rivulet-surrogates-1"
    #: Rows up to which exceptions, and the entities that draw again, are broadcast.
    broadcast_exceptions: int = 200_000


# Detection -----------------------------------------------------------------------------------

_LOCAL = set("abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_DIGITS = re.compile(r"[0-9](?:[0-9 ().\-]{5,})[0-9]")
_IPV4 = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")
_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"(?<![0-9A-Za-z.])(\+[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9]|[.-][0-9])")
# Unseparated or freely grouped numbers after a country code, pairs as in France, and ten digits after a word.
_PHONES = (
    _PHONE,
    re.compile(r"(?<![0-9A-Za-z.+])(\+[0-9]{1,3})(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9]|[.-][0-9])"),
    re.compile(r"(?<![0-9A-Za-z.+-])()0[1-9](?:[ .-][0-9]{2}){4}(?![0-9]|[ .-][0-9])"),
    re.compile(r"(?:(?i:\b(?:phone|telephone|tel|call|mobile|fax|téléphone|telefon|teléfono|móvil|handy)\b)[ .:]{1,3})()(?P<own>[0-9]{9,11})(?![0-9])"),
)
_TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Dr": "n", "Prof": "n",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
_NAME = re.compile(r"\b(" + "|".join(sorted(_TITLES, key=len, reverse=True)) + r")\b\.?[  ]((?:[^\W\d_][\w'’-]+)(?:[  ][^\W\d_][\w'’-]+)?)")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    #: What is equal for all mentions of an entity; for names "role:gender:script:form".
    canon: str


def _script(word: str) -> str:
    c = next((x for x in word if x.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _names(text: str) -> list[Entity]:
    out: list[Entity] = []
    forms: dict[str, str] = {}
    for m in _NAME.finditer(text):
        words = [(m.start(2) + w.start(), w.group()) for w in re.finditer(r"[^  ]+", m[2])]
        words = [(at, w) for i, (at, w) in enumerate(words) if w[0].isupper() and all(v[0].isupper() for _, v in words[:i])]
        gender = _TITLES[m[1]]
        for i, (at, w) in enumerate(words):
            role = "given" if i + 1 < len(words) else "family"
            canon = _name_canon(role, gender, w)
            forms.setdefault(w, canon)
            out.append(Entity(at, at + len(w), "name", canon))
    if forms:
        taken = {e.start for e in out}
        again = re.compile(r"(?<![\w])(" + "|".join(re.escape(w) for w in sorted(forms, key=len, reverse=True)) + r")(?![\w])")
        out += [Entity(m.start(), m.end(), "name", forms[m[1]]) for m in again.finditer(text) if m.start() not in taken]
    return out


def _name_canon(role: str, gender: str, word: str) -> str:
    script, form = _script(word), word.casefold()
    if role == "family":
        if script == "cyrillic" and gender == "f" and re.search("(ов|ев|ин|ын)а$", form):
            form = form[:-1]  # the family's masculine form, so both genders stay together
        return f"family::{script}:{form}"
    return f"given:{gender}:{script}:{form}"


def detect(text: str) -> list[Entity]:
    """Entities in order, without overlaps; earlier kinds win."""
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        lo = at
        while lo > 0 and text[lo - 1] in _LOCAL:
            lo -= 1
        while lo < at and text[lo] in ".-%+_":
            lo += 1
        if m and lo < at:
            found.append(Entity(lo, m.end(), "email", text[lo : m.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGITS.search(text):
        for m in _IPV4.finditer(text):
            parts = [int(x) for x in m[0].split(".")]
            if max(parts) < 256:
                found.append(Entity(m.start(), m.end(), "ipv4", ".".join(map(str, parts))))
        found += [Entity(m.start(), m.end(), "card", re.sub("[^0-9]", "", m[0])) for m in _CARD.finditer(text)]
        found += [Entity(m.start(), m.end(), "ssn", re.sub("[^0-9]", "", m[0])) for m in _SSN.finditer(text)]
        for m in (x for pattern in _PHONES for x in pattern.finditer(text)):
            lo, hi = m.span("own") if "own" in m.re.groupindex else m.span()
            digits = re.sub("[^0-9]", "", text[lo:hi])
            if 7 <= len(digits) <= 15:
                code = re.sub("[^0-9]", "", m[1] or "")
                found.append(Entity(lo, hi, "phone", f"{code}:{digits[len(code):]}"))
    if any(title in text for title in _TITLES):
        found += _names(text)
    if len(found) < 2:
        return found
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (KINDS.index(e.kind), e.start)):
        if all(e.end <= o.start or o.end <= e.start for o in out):
            out.append(e)
    return sorted(out, key=lambda e: e.start)


# Surrogates ----------------------------------------------------------------------------------


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "big")


def permute(symbols: list[int], base: int, key: bytes, tweak: str, rounds: int = 8) -> list[int]:
    """A keyed permutation of all strings of this length: an unbalanced Feistel network."""
    n = len(symbols)
    if n == 0:
        return symbols
    if n == 1:
        return [(symbols[0] + 1 + _prf(key, tweak, base) % (base - 1)) % base]
    u = n // 2
    left, right = symbols[:u], symbols[u:]
    for i in range(rounds):
        m = len(left)
        value = (_number(left, base) + _prf(key, tweak, base, n, i, _number(right, base))) % base**m
        left, right = right, _symbols(value, base, m)
    return left + right


def _number(x: list[int], base: int) -> int:
    out = 0
    for d in x:
        out = out * base + d
    return out


def _symbols(value: int, base: int, n: int) -> list[int]:
    out = [0] * n
    for i in range(n - 1, -1, -1):
        value, out[i] = divmod(value, base)
    return out


def _walk(symbols: list[int], base: int, key: bytes, tweak: str, same: Callable[[list[int]], object]) -> list[int]:
    """Permute until the class is that of the original: a permutation of the class."""
    wanted, out = same(symbols), permute(symbols, base, key, tweak)
    while same(out) != wanted:
        out = permute(out, base, key, tweak)
    return out


def _pattern(word: str, key: bytes, tweak: str) -> str:
    """Letters become letters and digits digits, run by run; other signs stay."""
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", word))
    out = []
    for i, m in enumerate(re.finditer(r"[a-z]+|[0-9]+|[^a-z0-9]+", word)):
        run = m[0]
        if run[0].isdigit() and run.isascii():
            out.append("".join(map(str, permute([int(c) for c in run], 10, key, f"{tweak}:{shape}:{i}"))))
        elif "a" <= run[0] <= "z":
            out.append("".join(chr(97 + x) for x in permute([ord(c) - 97 for c in run], 26, key, f"{tweak}:{shape}:{i}")))
        else:
            out.append(run)
    return "".join(out)


def _network(bits: list[int]) -> str:
    a, b = (_number(bits[i : i + 8], 2) for i in (0, 8))
    if a == 10:
        return "10"
    if a == 172 and 16 <= b < 32:
        return "172.16"
    if a == 192 and b == 168:
        return "192.168"
    return "special" if a in (0, 127) or a >= 224 else "public"


# Syllables and endings of made-up names.
_NAME_PARTS = {
    "latin": ("bdfghklmnprstvw", "aeiou", {"m": ("n", "r", "to", "lf"), "f": ("a", "ra", "na", "lia"), "n": ("s", "l", "ry", "ne"), "": ("mann", "ler", "son", "berg")}),
    "cyrillic": ("бвгдзклмнпрст", "аеио", {"m": ("н", "р", "слав", "й"), "f": ("на", "ра", "ля", "я"), "n": ("ша", "ня", "ль", "ка"), "": ("ов", "ев", "ин", "ын")}),
    "greek": ("βγδζκλμνπρστ", "αειο", {"m": ("ος", "ης", "ας", "ων"), "f": ("α", "η", "ια", "ινα"), "n": ("ι", "ω", "υς", "ες"), "": ("ίδης", "άκης", "όπουλος", "άτος")}),
}


def _made_name(key: bytes, role: str, gender: str, script: str, form: str, attempt: int) -> str:
    consonants, vowels, endings = _NAME_PARTS[script]
    draw = _prf(key, "name", role, gender, script, form, attempt)
    out = ""
    for _ in range(2 + attempt // 4):  # longer names as shorter ones run out
        draw, c = divmod(draw, len(consonants))
        draw, v = divmod(draw, len(vowels))
        out += consonants[c] + vowels[v]
    own = endings[gender if role == "given" else ""]
    return out + own[draw % len(own)]


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_pattern(local, key, tweak + ':' + domain)}@{_pattern(host, key, tweak + ':' + top)}.{top}"
    if kind == "ipv4":
        bits = [int(b) for x in canon.split(".") for b in f"{int(x):08b}"]
        fixed = {"10": 8, "172.16": 12, "192.168": 16}.get(_network(bits), 0)
        rest = _walk(bits[fixed:], 2, key, f"{tweak}:{fixed}", (lambda x: _network(x) if not fixed else None))
        bits = bits[:fixed] + rest
        return ".".join(str(_number(bits[i : i + 8], 2)) for i in range(0, 32, 8))
    if kind == "card":
        digits = [int(c) for c in canon]
        if _luhn(canon):
            body = "".join(map(str, digits[:1] + permute(digits[1:-1], 10, key, f"{tweak}:{canon[0]}")))
            return next(body + c for c in "0123456789" if _luhn(body + c))
        return canon[0] + "".join(map(str, _walk(digits[1:], 10, key, f"{tweak}:{canon[0]}", lambda x: _luhn(canon[0] + "".join(map(str, x))))))
    if kind == "ssn":
        return "".join(map(str, permute([int(c) for c in canon], 10, key, tweak)))
    if kind == "phone":
        code, _, own = canon.partition(":")
        # an area code begins with 2 to 9, if the original's does
        return code + ":" + "".join(map(str, _walk([int(c) for c in own], 10, key, f"{tweak}:{code}", lambda x: x[0] >= 2)))
    role, gender, script, form = canon.split(":", 3)
    return f"{role}:{gender}:{script}:{_made_name(key, role, gender, script, form, attempt)}"


def _worn(mention: str, kind: str, canon: str, new: str) -> str:
    """The surrogate in the mention's layout."""
    if kind == "name":
        word = new.split(":", 3)[3]
        if canon.startswith("family::cyrillic:") and mention.casefold() == canon.split(":", 3)[3] + "а":
            word += "а"
        return word.upper() if len(mention) > 1 and mention.isupper() else word[0].upper() + word[1:]
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, new)) if len(mention) == len(new) else new
    if kind == "ipv4":
        return new
    digits = iter(new.replace(":", ""))
    return "".join(next(digits) if c in "0123456789" else c for c in mention)


def rewrite(text: str, attempts: Callable[[str, str], int], made: Callable[[str, str, int], str]) -> tuple[str, list[int]]:
    """The text with surrogates, and how many entities of each kind it had."""
    counts = [0] * len(KINDS)
    found = detect(text)
    if not found:
        return text, counts
    out, at = [], 0
    for e in found:
        counts[KINDS.index(e.kind)] += 1
        out += [text[at : e.start], _worn(text[e.start : e.end], e.kind, e.canon, made(e.kind, e.canon, attempts(e.kind, e.canon)))]
        at = e.end
    return "".join([*out, text[at:]]), counts


# Over tables ---------------------------------------------------------------------------------


def _entities(texts: DataFrame) -> DataFrame:
    """(k1, k2, kind, canon) of a table (text, k1, k2), once for each entity of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist())
            seen = [(a, b, *e) for a, b, t in rows if t for e in sorted({(e.kind, e.canon) for e in detect(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["k1", "k2", "kind", "canon"])

    return texts.mapInArrow(run, "k1 long, k2 long, kind string, canon string")


def shown(kind: str, canon: str) -> list[str]:
    """What a reader can see of an entity or a surrogate, without its layout."""
    if kind != "name":
        return [canon.replace(":", "")]
    role, _, script, form = canon.split(":", 3)
    forms = [form, form + "а"] if role == "family" and script == "cyrillic" else [form]
    return [f"{script}:{x}" for x in forms]


def _seen(rows: DataFrame) -> DataFrame:
    """(kind, canon, seen): what is shown of each entity of a table (kind, canon)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, c, x) for k, c in zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist()) for x in shown(k, c)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["kind", "canon", "seen"])

    return rows.select("kind", "canon").mapInArrow(run, "kind string, canon string, seen string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, seen): what is shown of the surrogates of a table (kind, canon, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, c, a, x) for k, c, a in zip(*(batch.column(n).to_pylist() for n in ("kind", "canon", "attempt"))) for x in shown(k, surrogate(k, c, key, a))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["kind", "canon", "attempt", "seen"])

    return rows.mapInArrow(run, "kind string, canon string, attempt int, seen string")


def exceptions(entities: DataFrame, key: bytes, most: int = 0) -> DataFrame:
    """(kind, canon, attempt) of the entities that have to draw again, of distinct (kind, canon).

    An entity gives way if what its surrogate shows is shown by an entity of the corpus, by the
    surrogate of a settled one, or by that of a smaller one that draws in the same round.  Settled
    entities aren't drawn again; up to ``most`` that are open are broadcast.
    """
    taken = checkpointed(_seen(entities).select("kind", "seen").distinct())
    turn, settled = entities.select("kind", "canon", F.lit(0).alias("attempt")), None
    while True:
        drawn = checkpointed(_drawn(turn, key))
        first = drawn.groupBy("kind", "seen").agg(F.min("canon").alias("first"))
        hit = taken.join(few(drawn.select("kind", "seen").distinct(), most), ["kind", "seen"], "left_semi").withColumn("hit", F.lit(True))
        judged = drawn.join(first, ["kind", "seen"]).join(hit, ["kind", "seen"], "left")
        judged = judged.groupBy("kind", "canon", "attempt").agg(F.max(F.col("hit").isNotNull() | (F.col("canon") != F.col("first"))).alias("clash"))
        judged = checkpointed(judged)
        own = judged.filter("not clash and attempt > 0").select("kind", "canon", "attempt")
        settled = own if settled is None else settled.unionByName(own)
        if judged.filter("clash").isEmpty():
            return settled
        new = drawn.join(judged.filter("not clash").select("kind", "canon"), ["kind", "canon"], "left_semi").select("kind", "seen")
        taken = taken.unionByName(new)
        turn = judged.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))


def _rewritten(rows: Rows, cfg: Privacy) -> DataFrame:
    """(row, counts): the rows with surrogates in their text, and how many entities of each kind."""
    text, at = rows.column("text"), rows.place("text")
    digest = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    found = _entities(rows.frame.select(text.alias("text"), *digest))
    entities = checkpointed(found.select("kind", "canon").distinct())
    again = checkpointed(exceptions(entities, cfg.key, cfg.broadcast_exceptions))
    held, docs = None, rows.frame
    if again.limit(max(0, cfg.broadcast_exceptions) + 1).count() <= cfg.broadcast_exceptions:
        held = rows.frame.sparkSession.sparkContext.broadcast({(r.kind, r.canon): r.attempt for r in again.collect()})
    else:  # by text, so that rows without an id or with a repeated one get their own
        own = found.distinct().join(again, ["kind", "canon"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("again"))
        docs = rows.frame.select("row", *digest).join(written(own, "again"), ["k1", "k2"], "left").select("row", "again")
    key = cfg.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(1 << 14)(lambda kind, canon, attempt: surrogate(kind, canon, key, attempt))
        shared = held.value if held else {}
        for batch in batches:
            row = batch.column("row")
            parts = [row.field(i) for i in range(row.type.num_fields)]
            per_row = batch.column("again").to_pylist() if not held else [None] * batch.num_rows
            out, counts = [], []
            for t, own in zip(parts[at].to_pylist(), per_row):
                table = {(x["kind"], x["canon"]): x["attempt"] for x in own} if own else shared
                new, n = rewrite(t, partial(_attempt, table), made) if t is not None else (None, [0] * len(KINDS))
                out.append(new)
                counts.append(n)
            parts[at] = pa.array(out, parts[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=list(row.type)), pa.array(counts, pa.list_(pa.int64()))], ["row", "counts"])

    return docs.mapInArrow(run, rows.schema("counts array<long>"))


def _attempt(table: dict[tuple[str, str], int], kind: str, canon: str) -> int:
    return table.get((kind, canon), 0)


def surrogates(docs: DataFrame, cfg: Privacy = Privacy()) -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates, and how many entities of each kind.

    A null text stays null and an empty one empty; texts without entities stay as they are; long
    texts are searched whole.  Rows of equal text get equal texts, whatever their id, null
    included.  Where two entities draw the same surrogate the smaller original keeps it.  No rows
    give no rows.  Extra columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)
    rows = Rows(Rows(docs).select("doc_id", "text"))
    out = _rewritten(rows, cfg)
    return rows.unpacked(out, **{f"n_{k}": F.element_at("counts", i + 1) for i, k in enumerate(KINDS)})


def rewritten(docs: DataFrame, cfg: Privacy = Privacy()) -> DataFrame:
    """The rows of docs, with all their columns; n_chars, if there, follows the new text.

    Cases are as for surrogates().
    """
    tune(docs.sparkSession)
    rows = Rows(docs)
    out = _rewritten(rows, cfg)
    if "n_chars" in rows.names:
        name = f"c{rows.place('n_chars')}"
        kind = rows.frame.schema["row"].dataType[name].dataType
        out = out.withColumn("row", F.col("row").withField(name, F.coalesce(F.length(rows.column("text")), F.lit(0)).cast(kind)))
    return rows.unpacked(out)
