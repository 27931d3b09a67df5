"""Secret scans: pattern spans, and random strings found by their token efficiency.

A string that a byte-pair vocabulary can only cut into very short tokens is
random: words and names compress to four or so characters a token, keys to
fewer than two. Known digests and identifiers are excluded from that test. It judges strings
outside pattern spans, and the values inside ``assign`` and ``access`` spans, which get a
span of their own if they are random.

Cases: a null text is the empty one and has no spans; texts are searched whole, and a very long
string is counted in parts, which adds a token a part at most;
repeated rows each get their spans; columns of any name but the output's pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import frugal, schema_with, slices

#: Kinds in the order in which spans that start together are listed.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Strings that the token test looks at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests by their length in hex digits, and identifiers, which are random but no secrets.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
NUMBERS = re.compile(r"[0-9+/_=-]+\Z")
#: Words joined by underscores, hyphens or slashes, each of letters with digits after them at most.
NAME = re.compile(r"(?:[A-Za-z]*[0-9]{0,4})(?:[_/-]+[A-Za-z]*[0-9]{0,4})*\Z")
PARTS = re.compile(r"[A-Za-z]{5}[A-Za-z]*[0-9]{0,4}")
#: Characters a token below which a string counts as random, and how much of that is asked of letters of one case,
#: which tokens cover better; words of the corpus have 2.2 and more.
RATIO, ONE_CASE = 2.0, 0.975
#: Characters that a rest of a candidate beside pattern spans needs; fewer tell nothing.
PIECE = 8


@lru_cache(maxsize=4)
def encoding(path: str | None):
    """The tiktoken vocabulary of a file, read once a worker; without a path that of ``byte_bpe_50k.tiktoken``."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ratio(string: str, path: str | None = None) -> float | None:
    """Characters per token of a string, as a part of what counts as random for its letters; None for digests and identifiers.

    A string of the form of a name is one if its longer parts compress like words, or if short parts make up most of it.
    """
    if any(known.match(string) for known in (DIGEST, UUID, NUMBERS)):
        return None
    judged, scale = [string], 1.0
    if NAME.match(string):
        judged = PARTS.findall(string)
        if 2 * sum(map(len, judged)) < len(string):
            return None
    if not re.search(r"[0-9]", string) and (string.islower() or string.isupper()):
        scale = ONE_CASE
    # Parts of bounded length, as the test needs no more and merging is not linear.
    tokens = sum(len(encoding(path).encode_ordinary(part[at : at + 4096])) for part in judged for at in range(0, len(part), 4096))
    return sum(map(len, judged)) / (tokens * scale)


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no span covers."""
    for a, _, b in sorted(spans):
        if a < end and start < b:
            if start < a:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def spans_of(text: str | None, path: str | None = None, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of every secret in a text, in order; positions are code points."""
    return judged_spans(text, path, ratio)[0]


def judged_spans(text: str | None, path: str | None = None, ratio: float = RATIO) -> tuple[list[tuple[int, int, int]], float | None]:
    """The spans of ``spans_of``, and the least token ratio of all strings that the token test took."""
    if not text:
        return [], None
    lower = text.lower() if text.isascii() else text.casefold()
    found, values = [], []
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        keys = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        found += [(a, 1, b) for a, b in keys]
        values += keys
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    fixed = list(found)
    for m in CANDIDATE.finditer(text):
        patterns = [x for x in fixed if x[0] < m.end() and m.start() < x[2]]
        values += [(a, b) for a, b in outside(m.start(), m.end(), patterns) if b - a >= PIECE]
    least = None
    for a, b in values:
        if (found_ratio := token_ratio(text[a:b], path)) is not None:
            least = found_ratio if least is None else min(least, found_ratio)
            if found_ratio < ratio:
                found.append((a, 3, b))
    return sorted(set(found)), least


def with_spans(docs: DataFrame, text: str, out: str, path: str | None = None, ratio: float = RATIO, least: str | None = None) -> DataFrame:
    """``docs`` and the spans of its text column as an array of (kind, start, end) named ``out``; and the least token ratio if a name for it is given."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            judged = [judged_spans(t, path, ratio) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans, _ in judged]
            columns = [pa.array(found, span), *([pa.array([r for _, r in judged], pa.float64())] if least else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, out, *([least] if least else [])])

    schema = schema_with(docs, out, "array<struct<kind:string,start:int,end:int>>")
    return docs.mapInArrow(add, schema.add(least, "double") if least else schema)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, text: str, out: str, mask: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """``docs`` and its text with every secret replaced by ``mask``; overlapping spans become one mask."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            done = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                pieces, at = [], 0
                for start, _, end in spans_of(t, path):
                    if start >= at:
                        pieces += [t[at:start], mask]
                    at = max(at, end)
                done.append(t if not pieces else "".join([*pieces, t[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(frugal(add), schema_with(docs, out, "string"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: counts of each kind, a digest of the pattern spans, all spans, and the least token ratio found."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_spans(rows, "text", "found", path, least="least_ratio").select("id", "found", "least_ratio")
    counts = [counted(F.col("found"), k).alias(f"n_{k}") for k in KINDS]
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "least_ratio"
    )
