"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash of the last bytes cuts texts into chunks, so equal passages give
equal chunks wherever they stand. A worker encodes and decodes a chunk once and
uses the result in every later document that holds it (a store of
bounded size; no text is shuffled). The vocabulary's pre-tokenizer always
starts anew where a blank follows another character, whatever stands around:
the part of a chunk between its first and last such place (its core) is
encoded alike in any text. What lies between the cores of two chunks is
the join; it is encoded again as a whole, and where a chunk has no core the join
grows over it until such places agree on both sides.

Ranks are read from the same tokenizer file; chunks of characters beyond the
European scripts, where Unicode tables of libraries may differ, and special
tokens follow the tokenizers library itself.

Defined results: a null or empty text has no tokens and the hashes of no
bytes; rows that repeat are encoded one by one; other columns are not read;
an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, text_or_empty

#: Bytes that decide a cut, bits of the hash that must be zero, and bytes between cuts at least and at most.
SPAN = 32
MASK = (1 << 9) - 1
LEAST, MOST = 128, 4096
#: Characters of chunks, and joins, that a worker keeps.
STORED = 16_000_000
JOINS = 100_000
#: Characters whose ids are sent on together.
SENT = 1_000_000

# The pre-tokenizer of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDGE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
BEYOND = re.compile(r"[^\x00-ɏ‐-‧]")

_random = np.random.default_rng(20240305)
BYTES = _random.integers(0, 2**63, 256, dtype=np.uint64)


def cuts(data: bytes) -> list[int]:
    """The chunk borders of ``data``: where the hash of the SPAN bytes before has its low bits zero, between characters."""
    if len(data) <= LEAST:
        return [0, len(data)]
    raw = np.frombuffer(data, np.uint8)
    # Every byte's value, turned by its age: a cyclic polynomial over the last SPAN bytes, by doubling.
    h, width = BYTES[raw], 1
    while width < SPAN:
        turned = (h[:-width] << np.uint64(width)) | (h[:-width] >> np.uint64(64 - width))
        h, width = turned ^ h[width:], width * 2
    places = np.flatnonzero((h & np.uint64(MASK)) == 0) + SPAN
    out = [0]
    for p in [*places.tolist(), len(data)]:
        while p - out[-1] > MOST:
            q = out[-1] + MOST
            while data[q] & 0xC0 == 0x80:
                q -= 1
            out.append(q)
        if p - out[-1] >= LEAST and p < len(data) and data[p] & 0xC0 != 0x80:
            out.append(p)
    out.append(len(data))
    return out


class Part(NamedTuple):
    """An encoded text: its ids in decimal, joined by commas, their number, and what they decode to."""

    ids: str
    n: int
    data: bytes


class Chunk(NamedTuple):
    """A chunk as head, core and tail; without a core it is all head."""

    head: str
    core: Part | None
    tail: str


class ChunkEncoder:
    """Encodes with a byte-level vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Byte-level vocabularies write bytes that don't print as characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: OrderedDict[str, Chunk] = OrderedDict()
        self.joins: dict[str, Part] = {}
        self.size = 0
        self.seen = self.reused = 0

    @cached_property
    def library(self):
        """The tokenizers library's own encoder, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    def encode(self, text: str) -> Part:
        """A text on its own, without special tokens, and its decoding."""
        if BEYOND.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return Part(",".join(map(str, ids)), len(ids), self.fast.decode_bytes(ids))
        ids = self.fast.encode_ordinary(text)
        return Part(",".join(map(str, ids)), len(ids), self.fast.decode_bytes(ids))

    def chunk(self, text: str) -> Chunk:
        self.seen += 1
        found = self.chunks.get(text)
        if found is not None:
            self.reused += 1
            self.chunks.move_to_end(text)
            return found
        edges = EDGE.search(text)
        if edges is None:
            found = Chunk(text, None, "")
        else:
            a = edges.start()
            b = max(m for m in (text.rfind(c, a) for c in " \t\n\r"))
            while b > a and text[b - 1].isspace():
                b -= 1
            found = Chunk(text[:a], self.encode(text[a:b]) if b > a else Part("", 0, b""), text[b:])
        self.chunks[text] = found
        self.size += len(text)
        while self.size > STORED:
            old, _ = self.chunks.popitem(last=False)
            self.size -= len(old)
        return found

    def join(self, text: str) -> Part:
        if not text:
            return Part("", 0, b"")
        found = self.joins.get(text)
        if found is None:
            if len(self.joins) >= JOINS:
                self.joins.clear()
            found = self.encode(text)
            if len(text) < 128:
                self.joins[text] = found
        return found

    def ordinary(self, text: str) -> list[Part]:
        """The parts of a text without special tokens, in order."""
        data = text.encode()
        at = cuts(data)
        out, between = [], ""
        for a, b in zip(at, at[1:], strict=False):
            c = self.chunk(data[a:b].decode())
            between += c.head
            if c.core is not None:
                out += [self.join(between), c.core]
                between = c.tail
        out.append(self.join(between))
        return out

    def parts(self, text: str) -> list[Part]:
        """The parts of any text; special strings in it are their tokens, as the library has it."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.ordinary(text)
        out = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append(Part(str(self.special[piece]), 1, piece.encode()))
            elif piece:
                out += self.ordinary(piece)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker and vocabulary, kept between tasks."""
    return ChunkEncoder(path)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for ids, texts in columns_of(batches):
            n, of_ids, of_text = [], [], []
            for text in texts:
                parts = [p for p in e.parts(text) if p.n]
                n.append(sum(p.n for p in parts))
                of_ids.append(hashlib.sha256(",".join(p.ids for p in parts).encode()).hexdigest())
                decoded = b"".join(p.data for p in parts).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield batch(DIGEST, [ids, n, of_ids, of_text])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, the ids themselves, and the columns ``keep``, in the order of the rows."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"), *keep)

    def pack(b: pa.RecordBatch, at: int, found: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in found]
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        ids, _, *others = b.slice(at, len(found)).columns
        schema = pa.schema([*TOKENS, *(b.schema.field(i) for i in range(2, b.num_columns))])
        return batch(schema, [ids, sizes, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))), *others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            held, at, size = [], 0, 0
            for k, text in enumerate(b.column(1).to_pylist()):
                held.append(np.fromstring(",".join(p.ids for p in e.parts(text) if p.n), np.int32, sep=","))
                size += len(text)
                if size >= SENT or k + 1 == b.num_rows:
                    yield pack(b, at, held)
                    held, at, size = [], k + 1, 0

    return rows.mapInArrow(run, ", ".join(["doc_id long, n_tokens long, ids array<int>", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)]))
