"""Secret scans.

Base patterns (assignments, access keys, hex runs) are matched over the whole text. Beyond them, every candidate string
(a run of key characters of ``SIZE`` or more) is scanned with a sliding window of ``SIZE`` characters: the Shannon entropy
of the window is updated from incremental counts and held against the limit of the narrowest character class that the
window fits. Windows above the limit are joined to spans. An allow-list names strings, pieces of strings, and what stands before a
string; a piece is left out and what stands beside it is scanned.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import in_chunks, records, sliced

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "entropy"]

SIZE = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LOWER, _UPPER, _NUMBERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Character classes from narrow to wide, with the entropy (bits a character) that a window has to exceed. Letters alone
#: need more of it, as long words come near that of random ones.
CLASSES = [
    ("digit", frozenset(_NUMBERS), math.inf),
    ("hex", frozenset(_NUMBERS + "abcdefABCDEF"), 3.0),
    ("lower", frozenset(_LOWER), 4.0),
    ("upper", frozenset(_UPPER), 4.0),
    ("letter", frozenset(_LOWER + _UPPER), 3.9),
    ("alnum", frozenset(_NUMBERS + _LOWER + _UPPER), 3.7),
    ("base64", frozenset(_NUMBERS + _LOWER + _UPPER + "+/_=-"), 3.9),
]
#: For each character the classes that it isn't in.
_NOT_IN = {c: tuple(k for k, (_, members, _) in enumerate(CLASSES) if c not in members) for c in CLASSES[-1][1]}
def _along(run: str, least: int = 10) -> str:
    """The pattern of a run from its first ``least`` characters on, as far as a text follows it."""
    return run[:least] + "".join(f"(?:{c}" for c in run[least:]) + ")?" * (len(run) - least)


#: Strings that look random and aren't secret, as a whole: UUIDs, runs of one pattern, words put together with capitals.
ALLOWED = [re.compile(x) for x in (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.{1,4})\1+.?", r"(?=[A-Z]*[a-z])(?=[a-z]*[A-Z])(?:[A-Z]?[a-z]{3,}+|[A-Z]{2,5}+(?![A-Z]))++")]
#: Pieces of a string that are allowed by themselves, while what stands beside them is scanned on: integrity digests of
#: their full length, and the rows of digits, alphabet and keyboard.
ALLOWED_PIECE = re.compile(
    "|".join(f"(?<![A-Za-z0-9])sha{bits}-[A-Za-z0-9+/]{{{n}}}{'=' * pad}(?![A-Za-z0-9+/=])" for bits, n, pad in ((1, 27, 1), (256, 43, 1), (384, 64, 0), (512, 86, 2)))
    + f"|(?i:{_along('0123456789')}|{_along('abcdefghijklmnopqrstuvwxyz')}|{_along('qwertyuiopasdfghjklzxcvbnm')})"
)
MARKS = "+/_=-"
#: What stands before a string that isn't secret: the header of inline data, of any length.
_INLINE = re.compile(r"data:[\w.+-]*/?[\w.+-]*(?:;[\w=.-]+)*;base64,")
#: Links are scanned by their parts; a part of words and numbers joined by hyphens is a title.
_LINK = re.compile(r"(?:https?|ftp)://([^\s\"'<>]+)")
_TITLE = re.compile(r"(?:[A-Za-z]?[a-z]+|[0-9]+)(?:[-_](?:[A-Za-z]?[a-z]+|[0-9]+)){2,}")
_LOG = [0.0] + [n * math.log2(n) for n in range(1, SIZE + 1)]


def entropy_spans(candidate: str, size: int = SIZE) -> list[tuple[int, int]]:
    """Joined windows whose entropy exceeds their class's limit.

    The entropy of a window is log2(size) - sum(n * log2 n) / size over its character counts n; both the sum and the
    number of characters outside each class change by one character in and one out.
    """
    counts: dict[str, int] = {}
    outside = [0] * len(CLASSES)
    total, spans, whole = 0.0, [], math.log2(size)
    limits = [limit for _, _, limit in CLASSES]
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        for k in _NOT_IN[c]:
            outside[k] += 1
        if i >= size:
            gone = candidate[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += _LOG[n - 1] - _LOG[n]
            for k in _NOT_IN[gone]:
                outside[k] -= 1
        if i >= size - 1 and whole - total / size > limits[outside.index(0)]:
            start = i - size + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED)


def unallowed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The stretches of ``SIZE`` characters or more that are left of a candidate without its allowed pieces and the marks beside them."""
    at = a
    for start, end in [*(m.span() for m in ALLOWED_PIECE.finditer(text, a, b)), (b, b)]:
        x, y = at, start
        while at > a and x < y and text[x] in MARKS:
            x += 1
        while start < b and x < y and text[y - 1] in MARKS:
            y -= 1
        if y - x >= SIZE:
            yield x, y
        at = end


def _mixed(s: str) -> bool:
    """Whether a string has a digit and a letter, or letters only."""
    return s.isalpha() or any(map(str.isdigit, s)) and any(map(str.isalpha, s))


def link_parts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Places of the user info's parts, the path's segments and the values of query and fragment; ``a`` is after the scheme."""
    host = next((i for i in range(a, b) if text[i] in "/?#"), b)
    path = next((i for i in range(host, b) if text[i] in "?#"), b)
    at = text.rfind("@", a, host)
    for start, end, mark in ((a, at, ":"), (host, path, "/"), (path, b, "?&;#")):
        while start < end:
            stop = next((i for i in range(start, end) if text[i] in mark), end)
            named = text.find("=", start, stop) if "?" in mark else -1
            if stop > start:
                yield (named + 1 if 0 <= named < stop - 1 else start), stop
            start = stop + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, sorted; ends are exclusive, offsets are code points."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base)


def random_spans(text: str) -> Iterator[tuple[int, int]]:
    """The spans of windows of candidates whose entropy exceeds their limit, without what the allow-list names."""
    links = [(m.start(), m.end(), m.start(1)) for m in _LINK.finditer(text)] if "://" in text else []
    from_ = [a for a, _, _ in links]
    inline = {m.end() for m in _INLINE.finditer(text)} if ";base64," in text else ()
    candidates = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    candidates = [(a, b) for a, b in candidates if not ((k := bisect_right(from_, a)) and a < links[k - 1][1])]
    for _, b, a in links:
        for start, end in link_parts(text, a, b):
            candidates += [(m.start(), m.end()) for m in CANDIDATE.finditer(text, start, end) if not _TITLE.fullmatch(m[0])]
    for a, b in candidates:
        if a in inline or not _mixed(text[a:b]) or allowed(text[a:b]):
            continue
        for start, end in unallowed(text, a, b):
            if _mixed(text[start:end]) and not allowed(text[start:end]):
                for i, j in entropy_spans(text[start:end]):
                    if _mixed(text[start + i : start + j]):
                        yield start + i, start + j


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, entropy spans that a base span holds and that aren't listed again)."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    more, hidden = [], 0
    for a, b in random_spans(text):
        k = bisect_right(starts, a)
        if k and reach[k - 1] >= b:
            hidden += 1
        else:
            more.append((a, 3, b))
    return base, sorted(base + more), hidden


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64()), ("n_entropy_hidden", pa.int64())])

    def rows():
        for doc_id, text in records(batches, "doc_id", "text"):
            base, spans, hidden = scan(text or "")
            n = [0] * len(KINDS)
            for _, k, _ in spans:
                n[k] += 1
            yield doc_id, *n[:3], hashlib.sha256(named(base).encode()).hexdigest(), named(spans), n[3], hidden

    yield from in_chunks(rows(), schema)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy,
    n_entropy_hidden.

    An assignment's span is the whole match, from the name to the value's end. An entropy span inside a base span is not
    listed again; ``n_entropy_hidden`` counts those.

    Defined cases: a null text counts as empty and has no span. A very long text is scanned whole, in time in proportion to
    its length. Null and repeated doc_ids and repeated rows give a row
    each. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, n_entropy_hidden long")


def redacted(text: str) -> str:
    """The text with each span (joined where they overlap) replaced by a mark that names its kind."""
    out, at = [], 0
    for a, k, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with secrets replaced by marks, ``n_chars`` following the text.

    Defined cases: null texts stay null and empty ones empty; a very long text is scanned whole; repeated rows stay as often
    as they come; an empty table gives an empty result; columns of any name and type are handed on.
    """

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            i = b.schema.get_field_index("text")
            new = pa.array([None if t is None else redacted(t) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    out = docs.mapInArrow(function, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
