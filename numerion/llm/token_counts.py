"""Token counts at every prefix, by dynamic programming over a byte-pair vocabulary.

The encoding of a prefix ends in one token, and two neighbouring tokens of
an encoding are themselves the encoding of their joined text. So the count at a
prefix is one more than the count before its last token, and the last token is the one
candidate that fits the last token before it. One pass over a
text gives the counts of all its prefixes, kept as an array; its length in tokens, a cut or a
budget are lookups there, not another encoding.

No piece of the vocabulary has a blank after another character, so text
falls apart before each run of blanks, and further between characters that no
piece holds next to each other. The steps from each prefix's count to the next are then
those of the parts, one after another, and the parts that were seen
before are not worked out again (tables of bounded size per worker).

Defined results: a null or empty text has no bytes and no tokens; rows that
repeat are counted one by one; other columns are not read; an empty
table gives an empty result; texts of any length are counted whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, text_or_empty

LIMIT = 4096
#: Characters whose counts are sent on together.
SENT = 1_000_000
#: Words and parts that a worker remembers, at about 180 bytes each.
WORDS = 300_000
PARTS = 900_000
BLANK = "▁"
WORD = re.compile(r"▁*[^▁]+|▁+")


class Remembered(dict):
    """Steps by text; unknown ones are worked out, and those of long texts not kept."""

    def __init__(self, most: int, make) -> None:
        self.most, self.make = most, make

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.make(text)
        if len(text) < 64:
            self[text] = found
        return found


class PrefixCounter:
    """Counts of a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.together = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        #: What pieces begin with: true for a piece itself.
        self.heads = {p[:i]: False for p in self.scores for i in range(1, len(p))} | dict.fromkeys(self.scores, True)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.parts = Remembered(PARTS, self.steps)
        self.words = Remembered(WORDS, lambda word: b"".join(map(self.parts.__getitem__, self.split(word))))

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text: join the best neighbours, leftmost first, while any are a piece."""
        s, scores = list(text), self.scores
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = scores.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def prefixes(self, part: str) -> list[int]:
        """The token count of each prefix of ``part``, the empty one first.

        From each prefix, whose last token is known, every piece that starts there is tried; it ends a prefix's encoding
        if it and the last token are the encoding of their joined text.
        """
        heads, pairs, size = self.heads, self.pairs, len(part)
        last: list[str | None] = [""] + [None] * size
        counts = [0] * (size + 1)
        for start in range(size):
            left = last[start]
            known = pairs.get(left)
            if known is None:
                if len(pairs) > len(heads):
                    pairs.clear()
                known = pairs[left] = {}
            for end in range(start + 1, size + 1):
                token = part[start:end]
                whole = heads.get(token)
                if last[end] is None and (whole or end == start + 1):
                    fits = known.get(token)
                    if fits is None:
                        fits = known[token] = self.merge(left + token) == ([left, token] if left else [token])
                    if fits:
                        last[end] = token
                        counts[end] = counts[start] + (1 if whole else len(token.encode()))
                if whole is None:
                    break
        return counts

    def steps(self, part: str) -> bytes:
        """From each prefix's count to the next, as 16-bit numbers (a step is at most a few pieces or the bytes of a character)."""
        counts = self.prefixes(part)
        return array("h", [b - a for a, b in zip(counts, counts[1:], strict=False)]).tobytes()

    def split(self, word: str) -> list[str]:
        """``word`` cut where no piece holds both neighbours."""
        together, out, a = self.together, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in together:
                out.append(word[a:i])
                a = i
        out.append(word[a:])
        return out

    def words_of(self, text: str) -> list[str]:
        return WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def every_prefix(self, text: str) -> np.ndarray:
        """The token count of each prefix of ``text`` in characters; [k] is that of ``text[:k]``."""
        steps = b"".join(map(self.words.__getitem__, self.words_of(text)))
        counts = np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int32) if steps else np.zeros(1, np.int32)
        # The blank that stands before every text is no character of it.
        counts[0] = 0
        return counts


def fit(counts: np.ndarray, budget: int) -> int:
    """The most characters whose count is within ``budget``.

    Counts may fall by a few when a character completes a piece, so the last
    such prefix is looked for from the end.
    """
    n = len(counts)
    return n - 1 - int(np.argmax(counts[::-1] <= budget))


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per worker and vocabulary, kept between tasks."""
    return PrefixCounter(path)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the characters that fit ``limit`` tokens.

    All read from the counts at every prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for ids, texts in columns_of(batches):
            n, fits = [], []
            for text in texts:
                at = c.every_prefix(text)
                n.append(int(at[-1]))
                fits.append(fit(at, limit))
            yield batch(COUNTS, [ids, [len(t.encode()) for t in texts], n, [k > limit for k in n], fits])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


PREFIXES = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts: the exact token count at every prefix in characters, the empty one first.

    What answers any cut and any budget later without the text being encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for ids, texts in columns_of(batches):
            held, at, size = [], 0, 0
            for k, text in enumerate(texts):
                held.append(c.every_prefix(text))
                size += len(text)
                if size >= SENT or k + 1 == len(texts):
                    offsets = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                    yield batch(PREFIXES, [ids[at : k + 1], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))])
                    held, at, size = [], k + 1, 0

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, counts array<int>")


def within(table: DataFrame, budget: int) -> DataFrame:
    """doc_id, chars: the longest prefix within ``budget`` tokens, by lookup in a prefix table (null for a budget under 0)."""
    back = F.array_position(F.reverse(F.transform("counts", lambda c: c <= budget)), True)
    return table.select("doc_id", F.when(back > 0, F.size("counts") - back).alias("chars"))


def tokens_of(table: DataFrame, chars: int) -> DataFrame:
    """doc_id, n_tokens: the tokens of each text cut to at most ``chars`` characters, by lookup in a prefix table."""
    return table.select("doc_id", F.element_at("counts", F.least(F.size("counts"), F.lit(max(chars, 0) + 1))).cast("long").alias("n_tokens"))
