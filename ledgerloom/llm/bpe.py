"""Byte-pair encoding as a bounded-lookahead transducer, and its incremental decoder.

The vocabulary file is a parameter; nothing of it is stored here. Text arrives in
chunks. Pre-tokens leave the buffer once no later character can change them, and
inside a pre-token a token leaves once ``lookahead`` further bytes are known,
so working memory does not depend on a text's or a run's length.

Every text goes through ``Encoder`` and every pre-token through ``RunEncoder``; a worker
remembers the ids of short pre-tokens, each of which has been through it once.

Cases: a null text encodes as the empty one, which has no tokens; special tokens
in a text are matched as the library does; repeated rows each get their result; a very long
text is read by chunks; columns of any name but the output's pass through ``with_tokens``;
an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import schema_with, slices

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may go on as one of the pattern's contractions of two letters.
BEGUN = ("'r", "'v", "'l")
#: Characters read at once from a long text.
CHUNK = 65536
#: Bytes, besides two lookaheads, that a pre-token's encoder merges at once.
STEP = 512
#: Pre-tokens whose ids a worker remembers, and how long they are at most.
REMEMBERED, SHORT = 300_000, 256
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        top = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * top
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.decimal = [str(i) for i in range(top)]
        self.merges: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.append((self.ids[a], self.ids[b], self.ids[a + b]))
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        self.longest = max(map(len, self.ids))
        self.lookahead = self._lookahead()
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.guard = max(map(len, self.special), default=1) - 1
        self.known: dict[str, tuple[int, ...]] = _Remembered(self)

    def _lookahead(self) -> int:
        """Bytes after a token that settle whether it stands.

        A merge of rank r is only undone if a merge of lower rank takes the right
        end of what it joins, at some level of that right part; and that merge
        needs its own right part settled. So by ascending rank: the need of a
        merge is the largest of (bytes of the taker's right part + the taker's
        need) over all takers. A finished token can also still be joined on by any
        merge that starts with it, hence the last step over all merges.
        """
        made = {c: (a, b, r) for r, (a, b, c) in reversed(list(enumerate(self.merges)))}
        takers: dict[int, tuple[list[int], list[int]]] = {}  # left part: ranks, largest need so far
        most = 0
        for r, (a, b, _) in enumerate(self.merges):
            need, part, before = 0, b, r
            while True:
                ranks, needs = takers.get(part, ((), ()))
                if at := bisect_left(ranks, before):
                    need = max(need, needs[at - 1])
                if part not in made:
                    break
                _, part, before = made[part]
            own = len(self.bytes_of[b]) + need
            ranks, needs = takers.setdefault(a, ([], []))
            ranks.append(r)
            needs.append(max(own, needs[-1] if needs else 0))
            most = max(most, own)
        return most

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tokens of bytes that are all known: the lowest rank joins first, from the left."""
        ids = [self.of_byte[b] for b in piece]
        rank, merges = self.rank, self.merges
        if len(ids) <= SHORT:
            ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) < NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [merges[best][2]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank.get((ids[i], ids[i + 1]), NEVER)
            return ids
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue = [(rank[pair], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in rank]
        heapify(queue)
        while queue:
            best, i = heappop(queue)
            j, (first, second, joined) = after[i], merges[best]
            if j < 0 or ids[i] != first or ids[j] != second:
                continue
            ids[i], ids[j], after[i] = joined, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := rank.get((ids[left], ids[right]))) is not None:
                    heappush(queue, (found, left))
        return [x for x in ids if x >= 0]


class _Remembered(dict):
    """Ids by pre-token; forgets all when full, so a worker's memory is bounded."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        run = RunEncoder(self.vocabulary)
        ids = (*run.feed(piece.encode()), *run.finish())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class RunEncoder:
    """Tokens of one pre-token that arrives in parts; holds a few lookaheads of bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        v, step = self.vocabulary, 2 * (self.vocabulary.lookahead + self.vocabulary.longest) + STEP
        for at in range(0, len(part), step):
            self.held += part[at : at + step]
            if len(self.held) < step:
                continue
            end, safe = 0, len(self.held) - v.lookahead
            for i in v.encode_bytes(self.held):
                if end + len(v.bytes_of[i]) > safe:
                    break
                end += len(v.bytes_of[i])
                out.append(i)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        rest, self.held = self.held, b""
        return self.vocabulary.encode_bytes(rest)


class Encoder:
    """Tokens of a text that arrives in chunks."""

    _split = regex.compile(PATTERN)
    _class = [(regex.compile(rf"{c}+"), c) for c in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.buffer = vocabulary, ""
        self.run: tuple[RunEncoder, regex.Pattern, bool] | None = None
        self.special, self.guard = vocabulary.special_pattern, vocabulary.guard

    def feed(self, chunk: str) -> list[int]:
        """The ids that are settled with this chunk."""
        self.buffer += chunk
        return self._drain(False)

    def finish(self, rest: str = "") -> list[int]:
        """The ids that are left, after a last chunk."""
        self.buffer += rest
        return self._drain(True)

    def _drain(self, last: bool) -> list[int]:
        out: list[int] = []
        while found := self.special.search(self.buffer):
            self._plain(self.buffer[: found.start()], True, out)
            out.append(self.vocabulary.special[found[0]])
            self.buffer = self.buffer[found.end() :]
        if last:
            self._plain(self.buffer, True, out)
            self.buffer = ""
        else:  # the last characters may begin a special token
            used = self._plain(self.buffer[: max(0, len(self.buffer) - self.guard)], False, out)
            self.buffer = self.buffer[used:]
        return out

    def _plain(self, text: str, last: bool, out: list[int]) -> int:
        """Encode what of ``text`` is settled; returns how many characters that was."""
        at = 0
        if self.run:
            run, more, spaces = self.run
            found = more.match(text)
            at = found.end() if found else 0
            ended = last or at < len(text)
            if spaces and not (last and at == len(text)):
                at = max(0, at - 1)  # the last space of a run belongs to what follows
            out += run.feed(text[:at].encode())
            if not ended:
                return at
            out += run.finish()
            self.run = None
        known = self.vocabulary.known
        if last:
            out += chain.from_iterable(map(known.__getitem__, self._split.findall(text, at)))
            return len(text)
        for found in self._split.finditer(text, at):
            if found.end() == len(text):
                piece = found[0]
                if len(piece) > CHUNK:
                    more = next(p for p, _ in self._class if p.fullmatch(piece[-1]))
                    spaces = piece[-1].isspace()
                    part = piece[:-1] if spaces else piece
                    self.run = (RunEncoder(self.vocabulary), more, spaces)
                    out += self.run[0].feed(part.encode())
                    return at + len(part)
                break
            if found[0] == "'" and text[found.start() :] in BEGUN:
                break  # with the next letter the apostrophe may be part of a contraction
            out += known[found[0]]
            at = found.end()
        return at


class Decoder:
    """Text of tokens that arrive one after another; bytes of an unfinished character wait."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a file, read once a worker; without a path that of ``byte_bpe_50k.json``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Vocabulary(path)


def encode(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """Ids of a text in lists of bounded length."""
    encoder, at = Encoder(v), 0
    while len(text) - at > CHUNK:
        yield encoder.feed(text[at : at + CHUNK])
        at += CHUNK
    yield encoder.finish(text[at:])


def with_tokens(docs: DataFrame, text: str, out: str, path: str | None = None) -> DataFrame:
    """``docs`` without its text column but with the ids of the text, an array of ints named ``out``."""
    keep = [c for c in docs.columns if c != text]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, text):
            ids = [[i for part in encode(t or "", v) for i in part] for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, column], [*keep, out])

    return docs.mapInArrow(add, schema_with(docs.select(*[F.col(f"`{c}`") for c in keep]), out, "array<int>"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: tokens, digest of the ids joined by commas, digest of the text decoded from them."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, "text"):
            counts, hashes, back = [], [], []
            for text in batch.column(1).to_pylist():
                n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
                for ids in encode(text or "", v):
                    if ids:
                        of_ids.update(("," * (n > 0) + ",".join(map(v.decimal.__getitem__, ids))).encode())
                        of_text.update(decoder.feed(ids).encode())
                        n += len(ids)
                of_text.update(decoder.finish().encode())
                counts.append(n)
                hashes.append(of_ids.hexdigest())
                back.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = docs.select(F.col(id_col)).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(digest, fields)
