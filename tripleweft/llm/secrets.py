"""Secret scan with multipart credential linking.

Strong spans are found by pattern alone. Weak ones, an endpoint, a bare
40-character key or the value of a name such as secret_access_key, say nothing
by themselves: they are reported only if a complementary part of a credential
lies in the same scope.
The join of parts is an interval join on (document, scope); a document is one
row, so it runs by binary search inside the row and shuffles nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import slices
from tripleweft.llm.runtime import prepare

REACH: int | None = None  # most code points between parts of one credential; None: the whole scope
MASK = "[REDACTED]"

# The base patterns, their kinds in order, and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "endpoint", "key")

# The method's weak parts.
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|[a-z0-9][a-z0-9.-]{0,120}\.amazonaws\.com[^\s\"'<>]*")
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
NAMED = re.compile(
    r"""(?:secret(?:[\x20_.-]?access)?|account|private|shared(?:[\x20_.-]?access)?)[\x20_.-]?key["']?"""
    r"""[\x20\t]*(?::=|=>|[:=>])[\x20\t]*["']?([A-Za-z0-9+/_.=-]{5,}[A-Za-z0-9+/_=-])""",
    re.IGNORECASE | re.ASCII,
)
BREAK = re.compile(r"\n[ \t\r]*\n")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SPAN_SCHEMA = "array<struct<kind:string,start:bigint,end:bigint,linked:boolean>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())])
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """`(start, kind, end)` of the strong spans, leftmost and non-overlapping per kind."""
    found = []
    lowered = text.encode("utf-8", "replace").lower()
    if any(word in lowered for word in _WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def _inside(spans: list[tuple[int, str, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, separate spans holds a part."""
    at = bisect_right(spans, start, key=lambda s: s[0])
    return at > 0 and end <= spans[at - 1][2]


def _keys(text: str, endpoints: list[tuple[int, str, int]], access: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Bare keys and values of key names, none of them an access identifier.

    A run of one letter is filler. Paths are runs of letters and slashes too:
    inside an endpoint a key without digits needs a '=' before it.
    """
    found = set()
    for m in KEY.finditer(text):
        plain = not any(map(str.isdigit, m[0]))
        if plain and len(set(m[0]) - set("+/")) < 2:
            continue
        if plain and text[m.start() - 1 : m.start()] != "=" and _inside(endpoints, m.start(), m.end()):
            continue
        found.add(m.span())
    found.update(m.span(1) for m in NAMED.finditer(text))
    return [(start, "key", end) for start, end in sorted(found) if not _inside(access, start, end)]


def linked_spans(text: str, base: list[tuple[int, str, int]], reach: int | None) -> list[tuple[int, str, int]]:
    """The weak spans that have a complementary part in their scope and within `reach`, if given.

    An endpoint needs an access identifier or a secret; a key needs an access
    identifier or an endpoint. A part never vouches for one that it overlaps,
    and what lies inside an endpoint may be no more than a piece of an address:
    it vouches for no endpoint, and a key there needs an access identifier.
    Scopes are the blocks between blank lines.
    """
    reach = len(text) if reach is None else reach
    endpoints = []
    if "http" in text or ".amazonaws.com" in text:
        endpoints = [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    access = [s for s in base if s[1] == "access"]
    if not endpoints and not access:
        return []  # every link has one of the two
    keys = _keys(text, endpoints, access)
    within = [_inside(endpoints, start, end) for start, _, end in keys]
    outer = [key for key, held in zip(keys, within, strict=True) if not held]
    inner = [key for key, held in zip(keys, within, strict=True) if held]
    secrets = [s for s in base if s[1] != "access" and not _inside(endpoints, s[0], s[2])] + outer
    breaks = [m.start() for m in BREAK.finditer(text)]

    def joined(weak: list, partners: list) -> list:
        starts, ends = sorted(s for s, _, _ in partners), sorted(e for _, _, e in partners)
        kept = []
        for start, kind, end in weak:
            scope = bisect_left(breaks, start)
            low = breaks[scope - 1] if scope else -1  # parts never cross a break
            high = breaks[scope] if scope < len(breaks) else len(text)
            at = bisect_right(ends, start)
            before = at > 0 and ends[at - 1] > low and start - ends[at - 1] <= reach
            at = bisect_left(starts, end)
            after = at < len(starts) and starts[at] < high and starts[at] - end <= reach
            if before or after:
                kept.append((start, kind, end))
        return kept

    return joined(endpoints, access + secrets) + joined(outer, access + endpoints) + joined(inner, access)


def _scan(text: str | None, reach: int | None) -> list[dict]:
    text = text or ""
    base = base_spans(text)
    linked = linked_spans(text, base, reach)
    ordered = sorted((s, KINDS.index(k), e, flag) for part, flag in ((base, False), (linked, True)) for s, k, e in part)
    return [{"kind": KINDS[k], "start": s, "end": e, "linked": flag} for s, k, e, flag in ordered]


def find_secrets(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """`doc_id, spans` for every row of `doc_id, text`; one row out per row in.

    `spans` is ordered by start, then kind; offsets are code points, end
    exclusive; `linked` marks the weak ones. Null and empty texts have no
    spans, a null doc_id stays null, repeated rows each give a row, other
    columns are ignored, and an empty table gives an empty one. Texts are
    scanned whole, whatever their length.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = [_scan(text, reach) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPAN_SCHEMA}")


def redact_secrets(docs: DataFrame, reach: int | None = REACH, mask: str = MASK) -> DataFrame:
    """`docs` with every span of `find_secrets` replaced by `mask`.

    All rows and columns stay; overlapping spans become one mask. `n_chars`,
    if there, is set to the new length. Null texts stay null.
    """
    prepare(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        spans = _scan(text, reach)
        if not spans:
            return text
        out, done = [], 0
        for span in spans:
            if span["start"] >= done:
                out += [text[done : span["start"]], mask]
            done = max(done, span["end"])
        return "".join(out) + text[done:]

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = pa.array([clean(t) for t in part.column("text").to_pylist()], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", length.cast(kind))
    return out


def span_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined in the order of the spans."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def secret_report(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """Counts of strong spans, a digest of them, and all spans as text, per row."""
    found = find_secrets(docs, reach)
    base = F.filter("spans", lambda s: ~s["linked"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("bigint")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
