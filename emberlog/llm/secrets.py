"""Secret scans: credential patterns and sliding-window Shannon entropy."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table

#: Fixed values of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Candidates for the entropy scan, and the class that each belongs to: first match wins.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]+\Z"), 2.9),
    ("entropy_upper", re.compile(r"[A-Z0-9]+\Z"), 3.4),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.8),
)
WINDOW = 20

#: What is left of a candidate is no secret if it matches one of these.
ALLOWED = (
    r"[0-9]+\Z",
    r"[A-Za-z]+\Z",
    r"[a-z]+([-_/=+]+[a-z]+)*[-_/=+]*\Z",
    r"[A-Z]+([-_/=+]+[A-Z]+)*[-_/=+]*\Z",
    r"[-_/=+]+\Z",
)
#: Parts of a candidate that are no secrets: these, with the letters and digits that touch them.
HARMLESS = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?i:example|placeholder|changeme|xxxx|abcdefghij|0123456789)"
ALPHANUMERIC = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
KINDS = ("assign", "access", "hex", *(name for name, _, _ in CLASSES))


def high_entropy_spans(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of s whose Shannon entropy reaches threshold, in bits.

    Counts change by one character in and one out; the sum of c*log2(c) is
    kept up to date, so each step costs the same whatever the window.
    """
    if len(s) < window:
        return []
    clog = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += clog[c - 1] - clog[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += clog[c + 1] - clog[c]
        if i >= window - 1 and math.log2(window) - total / window >= threshold - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def harmless_parts(s: str, harmless: re.Pattern) -> list[tuple[int, int]]:
    """Disjoint parts of s, in order, that hold a match of harmless and all letters and digits next to it."""
    parts: list[tuple[int, int]] = []
    done = 0
    for m in harmless.finditer(s):
        start, end = m.span()
        if end <= done:
            continue
        while start > done and s[start - 1] in ALPHANUMERIC:
            start -= 1
        while end < len(s) and s[end] in ALPHANUMERIC:
            end += 1
        parts.append((max(start, done), end))
        done = end
    return parts


def gaps(start: int, end: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the cuts, in order of their start, leave of start to end."""
    for a, b in cuts:
        if start < a:
            yield start, min(a, end)
        start = max(start, b)
    if start < end:
        yield start, end


def find_secrets(text: str, allowed: Iterable[re.Pattern], harmless: re.Pattern = re.compile(HARMLESS)) -> list[tuple[str, int, int]]:
    """All spans of one text: base kinds, and entropy spans in what base spans and harmless parts leave of the candidates."""
    base: list[tuple[str, int, int]] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"akia" in low:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    found = list(base)
    cuts = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in cuts]
    longest = max((b - a for a, b in cuts), default=0)
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        near = cuts[bisect_left(starts, at - longest) : bisect_left(starts, end)]
        near = sorted([*near, *((at + a, at + b) for a, b in harmless_parts(m[0], harmless))])
        for a, b in gaps(at, end, [c for c in near if c[1] > at]):
            s = text[a:b]
            if len(s) < WINDOW or any(x.match(s) for x in allowed):
                continue
            kind, least = next((k, t) for k, p, t in CLASSES if p.match(s))
            found += [(kind, a + x, a + y) for x, y in high_entropy_spans(s, least)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(text: Column, allowed: tuple[str, ...] = ALLOWED, harmless: str = HARMLESS) -> Column:
    """Spans of each whole text: array of (kind, start, end), by code point, end exclusive.

    Null and empty texts have none. Ties at a start follow KINDS. Documents
    are independent: no shuffle, and repeated rows give equal results.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scan(texts: pa.Array) -> pa.Array:
        rules, parts = [re.compile(a) for a in allowed], re.compile(harmless)
        out = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t.as_py() or "", rules, parts)] for t in texts
        ]
        return pa.array(out, pa.list_(span))

    return scan(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: secrets in every whole text of documents, a row for each row; null, empty and repeated as in secret_spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return docs.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
