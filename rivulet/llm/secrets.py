"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of the widest character class.  In a candidate each class has its own
maximal runs, so a value that is glued to its name or path is judged by its own class; a window of
the class's width slides over them, and its entropy follows from S = sum c * log2 c of the window's
character counts, of which only two change with each step.  Windows of at least the class's
threshold that hold letters and digits are joined to spans, and so are overlapping spans of several
classes; a span is called after the narrowest class that holds all of it.
What is on the allow-list (UUIDs, dates, digests that are named so, placeholders, paths of URLs) is
marked sign by sign, and windows that hold a marked sign are suppressed; the rest of a run, and the
query of a URL, is still searched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.llm import textkernel as tk
from rivulet.llm.runtime import columns, texts, tune

# Fixed values of the base rules.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
LEAST = {"assign": 12, "access": 18, "hex": 16}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
_LOWER_HEX = _class(_DIGITS + "abcdef")
_DIGIT, _LETTER = _class(_DIGITS), _class(_LETTERS)


@dataclass(frozen=True)
class CharClass:
    """A character class, the window's width and the least entropy in bits."""

    kind: str
    chars: str
    width: int
    bits: float


#: From narrow to wide.  A random window has about 3.4, 4.1 and 4.2 bits.
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", 20, 3.0),
    CharClass("entropy_alnum", _DIGITS + _LETTERS, 20, 3.75),
    CharClass("entropy_base64", _DIGITS + _LETTERS + "+/_=-", 20, 3.9),
)
#: What looks random within a run and is no secret.
ALLOWED = (
    re.compile(rb"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"),
    re.compile(rb"(?<!\d)\d{4}-\d\d-\d\d([T_-][\d_+-]*Z?)?(?!\d)"),
    re.compile(rb"example|placeholder|xxxx+|0123456789|abcdefgh", re.IGNORECASE),
    re.compile(rb"(?<![0-9A-Za-z])(sha(1|256|384|512)|md5)[-_=][0-9A-Za-z+/]+={0,2}", re.IGNORECASE),
)
#: A name of a digest or commit that may stand before a run, with blanks between.
_NAMED = re.compile(rb"(?:sha(?:1|256|384|512)|md5|commit)[:=_-]?$", re.IGNORECASE)
_TOKEN = np.ones(256, bool)
_TOKEN[np.frombuffer(b" \t\n\x0b\x0c\r\"'<>", np.uint8)] = False
_QUERY = np.isin(np.arange(256), np.frombuffer(b"?#&=", np.uint8))

KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


def base_spans(text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in bytes of the base rules' matches."""
    raw, out = text.tobytes(), []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    starts, ends = tk.spans(text, _LOWER_HEX)
    long = ends - starts >= LEAST["hex"]
    return out + [(s, 2, e) for s, e in zip(starts[long].tolist(), ends[long].tolist())]


_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, 256)]


def entropy_windows(run: bytes, width: int, bits: float, marked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Joined windows of the run with at least so many bits, a letter, a digit and no marked sign.

    Counts change by the character that leaves and the one that enters.
    """
    if len(run) < width:
        return []
    counts = [0] * 256
    flags = marked.tolist() if marked is not None and marked.any() else None
    total = digits = letters = allowed = 0.0
    most = math.log2(width) * width - bits * width  # S of a window that is still accepted
    out: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= width:
            gone = run[i - width]
            total += _CLOGC[counts[gone] - 1] - _CLOGC[counts[gone]]
            counts[gone] -= 1
            digits -= _DIGIT[gone]
            letters -= _LETTER[gone]
            if flags:
                allowed -= flags[i - width]
        total += _CLOGC[counts[c] + 1] - _CLOGC[counts[c]]
        counts[c] += 1
        digits += _DIGIT[c]
        letters += _LETTER[c]
        if flags:
            allowed += flags[i]
        if i >= width - 1 and total <= most + 1e-9 and digits and letters and not allowed:
            if out and out[-1][1] >= i - width + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - width + 1, i + 1))
    return out


_WIDEST = _class(CLASSES[-1].chars)
_MEMBERS = [_class(c.chars) for c in CLASSES]
_SHORTEST = min(c.width for c in CLASSES)


class _Before:
    """What stands before a place of a text, however far back it began."""

    def __init__(self, raw: bytes, text: np.ndarray):
        self.raw = raw
        self.starts, _ = tk.spans(text, _TOKEN)
        self.queries = np.flatnonzero(_QUERY[text])
        self.urls: dict[int, int] = {}

    def path_of_url(self, s: int, e: int) -> int:
        """Where the part of the run from s to e that lies in the host or path of a URL ends."""
        token = int(self.starts[np.searchsorted(self.starts, s, side="right") - 1])
        if token not in self.urls:
            self.urls[token] = self.raw.find(b"://", token)
        at = self.urls[token]
        if not 0 <= at < s:
            return s
        i = int(np.searchsorted(self.queries, at))
        return min(e, max(s, int(self.queries[i]))) if i < len(self.queries) else e

    def named(self, s: int) -> bool:
        """Whether the word before the place, past blanks, names a digest or a commit."""
        end = s
        while end > 0 and self.raw[end - 1] == 0x20:
            end -= 1
        return _NAMED.search(self.raw, max(0, end - 7), end) is not None and (end == s or self.raw[s - 1] == 0x20)


def entropy_spans(text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in bytes of the windows of high entropy."""
    starts, ends = tk.spans(text, _WIDEST)
    long = ends - starts >= _SHORTEST
    out: list[tuple[int, int, int]] = []
    if not long.any():
        return out
    raw = text.tobytes()
    before = _Before(raw, text)
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        held = text[s:e]
        if not (_DIGIT[held].any() and _LETTER[held].any()):
            continue
        run, marked = raw[s:e], np.zeros(e - s, bool)
        for pattern in ALLOWED:
            for m in pattern.finditer(run):
                marked[m.start() : m.end()] = True
        marked[: before.path_of_url(s, e) - s] = True
        if before.named(s):
            first = tk.spans(held, _MEMBERS[1])
            marked[: int(first[1][0]) if len(first[0]) and first[0][0] == 0 else 0] = True
        found = []
        for c, member in zip(CLASSES, _MEMBERS):
            for lo, hi in zip(*(x.tolist() for x in tk.spans(held, member))):
                if hi - lo >= c.width:
                    found += [(s + lo + a, s + lo + b) for a, b in entropy_windows(run[lo:hi], c.width, c.bits, marked[lo:hi])]
        joined: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if joined and lo < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
            else:
                joined.append((lo, hi))
        out += [(lo, 3 + next(i for i, m in enumerate(_MEMBERS) if m[text[lo:hi]].all()), hi) for lo, hi in joined]
    return out


def _shown(spans: list[tuple[int, int, int]], text: np.ndarray) -> str:
    """kind:start:end in code points, by start, then kind as listed."""
    if not spans:
        return ""
    before = np.r_[0, np.cumsum(tk.LEAD[text])]
    return ",".join(f"{KINDS[k]}:{before[s]}:{before[e]}" for s, k, e in sorted(spans))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    spans holds the base rules' matches and those entropy spans that no base match covers.  A null
    or empty text has none; long texts and long runs are searched whole; repeated rows get equal
    results; no rows give no rows.  Where spans begin together the order of KINDS decides.  Extra
    columns are ignored, whatever their names.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, shown = [], [], []
            for t in texts(batch.column("text")):
                base = base_spans(t)
                more = [x for x in entropy_spans(t) if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)]
                n.append([sum(k == i for _, k, _ in base) for i in range(3)] + [len(more)])
                digests.append(hashlib.sha256(_shown(base, t).encode()).hexdigest())
                shown.append(_shown(base + more, t))
            counts = [pa.array([x[i] for x in n], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts[:3], pa.array(digests, pa.string()), pa.array(shown, pa.string()), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    rows = columns(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
