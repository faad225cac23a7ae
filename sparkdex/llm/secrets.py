"""Secret scans: base patterns, and weak credentials linked with their complements within a scope."""

from __future__ import annotations

import bisect
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, let_go, map_arrow

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

ASSIGN = re.compile(
    "".join(("(?:", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w).replace("?", "?") for w in ("password", "passwd", "secret", "token", "api_?key")), ")"))
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

WEAK_ID = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})", re.ASCII | re.IGNORECASE)
NAMED_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:pass|pwd|pin|key|credential)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{4,})", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(rf"{NAMED_SECRET.pattern}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{20,}}={{0,2}}(?![A-Za-z0-9+/_=-])", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,20}://[^\s\"'<>]{3,}|(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])")
DIGIT = re.compile(r"[0-9]")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, each kind leftmost and non-overlapping."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    """Candidates that are reported only beside their complement."""
    found = []
    named, digit = "=" in text or ":" in text, DIGIT.search(text)
    if named:
        found += [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text)]
    if named or digit:  # only a bare secret needs a digit
        found += [(m.start(), m.end(), "weak_secret") for m in (WEAK_SECRET if digit else NAMED_SECRET).finditer(text)]
    if digit or "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    return found


#: The part that a span of a kind plays.
PART = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}


def linked(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], breaks: list[int], reach: int) -> list[tuple[int, int, str]]:
    """The weak spans that have a complement in their scope: another paragraph ends it, and so does ``reach``.

    An interval join: each part's starts are sorted, and a weak span asks for a start of another part in
    [scope start, scope end]. Identifiers and endpoints need a secret, secrets an identifier or an endpoint.
    """
    starts = {p: sorted(a for a, _, k in base + weak if PART[k] == p) for p in ("id", "secret", "endpoint")}
    taken = [(a, b) for a, b, _ in base]
    out = []
    for a, b, kind in weak:
        k = bisect.bisect_right(taken, (a, float("inf"))) - 1
        if k >= 0 and taken[k][1] > a or k + 1 < len(taken) and taken[k + 1][0] < b:
            continue  # a base span says it already
        p = bisect.bisect_right(breaks, a)
        low = max(a - reach, breaks[p - 1] if p else 0)
        high = min(b + reach, breaks[p] - 1 if p < len(breaks) else b + reach)
        for other in ("id", "endpoint") if PART[kind] == "secret" else ("secret",):
            i = bisect.bisect_left(starts[other], low)
            if i < len(starts[other]) and starts[other][i] <= high:
                out.append((a, b, kind))
                break
    return out


PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def scan_text(text: str, reach: int) -> tuple[list, list]:
    """Base spans, and all spans."""
    base = base_spans(text)
    weak = weak_parts(text)
    parts = {PART[k] for _, _, k in base} | {PART[k] for _, _, k in weak}
    more = linked(base, weak, [m.end() for m in PARAGRAPH.finditer(text)], reach) if weak and {"id", "secret"} <= parts or weak and {"secret", "endpoint"} <= parts else []
    return base, sorted(set(base + more), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def rendered(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, reach: int = 400) -> DataFrame:
    """Secrets of every document: base patterns, and weak parts joined within scopes.

    A scope is a paragraph, and at most ``reach`` code points to either side. Weak identifiers, secrets and
    endpoints count only where a complement (of either strength) stands in their scope. Columns: doc_id,
    n_assign, n_access, n_hex, base_sha256 (of the base spans, kind:start:end by start, then kind), spans
    (all, joined likewise; code points, end exclusive). Null and empty texts have no spans. Each row of
    ``docs``, repeated or not, gives a row; other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, spans = scan_text(text or "", reach)
                kinds = [k for _, _, k in base]
                out.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)] if out else [pa.array([], t) for t in ARROW.types], schema=ARROW)

    return map_arrow(documents(docs), scan, SCHEMA)


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with its (start, end, kind) spans replaced; overlapping spans become one."""
    out, at, open_ = [], 0, 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[open_:a], mark]
        at = open_ = max(at, b)
    return "".join(out) + text[open_:]


def redacted_text(text, reach: int = 400):
    """A string column with every span that ``secret_scan`` reports replaced; null stays null."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        let_go()
        return texts.map(lambda t: t if t is None else redacted(t, spans) if (spans := scan_text(t, reach)[1]) else t)

    return redact(text)
