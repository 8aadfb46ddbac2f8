"""Secret scans: fixed patterns, and sliding-window entropy for what the patterns don't name.

Candidate strings are runs of 20 or more key characters. Over each, a window of fixed length
slides for each character class (hex digits, alphanumerics, base64 characters); its Shannon
entropy comes from counts that change by one character out and one in at each step. Windows above
the class's threshold are merged into spans. Strings that look like well-known harmless values
(UUIDs, paths, dates, numbers, repeated marks, words of letters) are on an allow-list, and so is
what has no digit: a candidate without one is not scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

# The base patterns, least lengths and kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more are what [0-9a-f]+ leaves after the length test
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Character class -> bits a character that a window must exceed. 20 characters have 4.32 at most.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "alnum": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.7),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.9),
}
ALLOW = [
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
    re.compile(r"[A-Za-z]+"),  # words, joined words
    re.compile(r"([A-Za-z]*[/_=-])+[A-Za-z]*"),  # paths, snake and kebab names
    re.compile(r"(.{1,4})\1+.{0,3}"),  # repetitions
]
_SELF = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 1)]


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOW)


def class_windows(text: str, members: frozenset, least_bits: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows wholly of one class whose entropy exceeds least_bits.

    H = log2(w) - sum(c log2 c) / w over the counts c; the sum is kept up to date as counts change.
    """
    selfs = _SELF if window == WINDOW else [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    limit = (math.log2(window) - least_bits) * window
    counts: dict[str, int] = {}
    total, begun, open_span = 0.0, 0, None
    for i, ch in enumerate(text):
        if ch not in members:
            counts, total, begun = {}, 0.0, i + 1
            continue
        c = counts.get(ch, 0)
        total += selfs[c + 1] - selfs[c]
        counts[ch] = c + 1
        at = i + 1 - window
        if at < begun:
            continue
        if at > begun:
            out = text[at - 1]
            c = counts[out]
            total += selfs[c - 1] - selfs[c]
            counts[out] = c - 1
        if total < limit - 1e-9:
            if open_span and at <= open_span[1]:
                open_span = (open_span[0], i + 1)
            else:
                if open_span:
                    yield open_span
                open_span = (at, i + 1)
    if open_span:
        yield open_span


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans in text of high entropy for some class, outside the allow-list, merged."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if allowed(word) or not any(c.isdigit() for c in word):
            continue
        found += [(m.start() + a, m.start() + b) for members, bits in CLASSES.values() for a, b in class_windows(word, members, bits)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, in code points, leftmost and apart for each kind."""
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def scan_text(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, matched text) of all spans, by start, then kind.

    An entropy span that lies within a base span is that base span's secret and isn't listed twice.
    """
    text = text or ""
    base = base_spans(text)
    more = [(a, "entropy", b) for a, b in entropy_spans(text) if not any(s <= a and b <= e for s, _, e in base)]
    return [(k, a, b, text[a:b]) for a, k, b in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))]


def _marked(column: pa.Array) -> np.ndarray:
    """Which texts can have a span at all: a quick look at whole bytes for runs and separators.

    Every entropy or hex or access span holds 20 key characters in a row, and every assign span a
    ':' or '=' and a keyword, whose letters this looks for by way of the separator alone.
    """
    from .common import text_chunks

    key = np.zeros(256, dtype=bool)
    key[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
    separator = np.zeros(256, dtype=bool)
    separator[[*b":="]] = True
    marked = np.zeros(len(column), dtype=bool)
    for chunk in text_chunks(column):
        other = np.flatnonzero(~key[chunk.data])
        edges = np.concatenate(([-1], other, [len(chunk.data)]))
        at = np.concatenate((edges[:-1][np.diff(edges) > WINDOW] + 1, np.flatnonzero(separator[chunk.data])))
        # A run that spans several texts marks the first; mark whatever text it reaches.
        ends = np.concatenate((edges[1:][np.diff(edges) > WINDOW] - 1, np.flatnonzero(separator[chunk.data])))
        first, last = np.searchsorted(chunk.offs, at, "right") - 1, np.searchsorted(chunk.offs, ends, "right") - 1
        for a, b in zip(first, last, strict=True):
            marked[chunk.lo + a : chunk.lo + b + 1] = True
    return marked


SPANS_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,secret:string>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and its spans (kind, start, end, secret), in order.

    docs: doc_id, text; more columns are ignored. A null or empty text has no spans; rows that
    repeat an id are scanned each. Map-only: no shuffle, and memory is bounded by a batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            spans = [[] if not hit else [{"kind": k, "start": a, "end": b, "secret": s} for k, a, b, s in scan_text(column[i].as_py())] for i, hit in enumerate(_marked(column))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, SPANS_SCHEMA)


def base_digest(spans: list[dict]) -> str:
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] != "entropy").encode()).hexdigest()


def secrets_query(docs: DataFrame) -> DataFrame:
    """The digest columns of op6, in SQL expressions over scan_secrets."""
    named = "transform({}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    base = "filter(spans, s -> s.kind <> 'entropy')"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) as long) n_{0}"
    return scan_secrets(docs).selectExpr("doc_id", *[count.format(k) for k in KINDS], f"sha2(array_join({named.format(base)}, ','), 256) base_sha256", f"array_join({named.format('spans')}, ',') spans")
