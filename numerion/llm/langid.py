"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word sums over all ways to cut it into pieces (the
forward algorithm: the mass of a prefix is the sum, over pieces that end there, of the
mass before the piece times the piece's probability). A text's score in a language
is the sum over its words.

A word is a run of letters (Unicode category L) of any length, with the mark that the vocabulary puts before words,
in training as in scoring. The mass is scaled every few characters and the logarithm
of the scale carried, so long words do not vanish.

Training counts are over all labelled training documents: a task counts its
words per language, cuts each distinct word once, and reports at most one row per
language and piece, so no source or language, however large, meets in one task.
Languages are scored TOGETHER at a time, each group with a model of its own that is sent to the tasks (at
most vocabulary x TOGETHER numbers); a text's best language and the sum of its likelihoods pass
from group to group, so there may be any number of languages.

Defined results: a null text, or one without letters, is ``und`` with score
0; without any training document every text is; rows that repeat are
predicted one by one, null ids count as the id ''; of languages with equal scores the
first by name is taken; lang, source and doc_id are no input of a prediction; an empty
table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, shared_table, text_or_empty

#: Letters, and the numbers that are written like letters (which are none).
LETTERS = re.compile(r"[^\W\d_]+")
BLANK = "▁"
#: Characters between two scalings of the mass.
SCALED = 8
#: Longer words are scored one by one.
LONG = 64
#: Characters, and numbers of masses, of words that are scored together.
CHARACTERS = 200_000
MASSES = 4_000_000
#: Words of texts that are looked up together.
LOOKED_UP = 200_000
#: Added to each piece's count, per language.
SMOOTH = 0.1
#: A character outside the vocabulary.
UNKNOWN = 1e-7
#: Languages of one model.
TOGETHER = 256
#: Words that a worker remembers at most, and the scores of words: one for each language.
REMEMBERED = 500_000
SCORES = 8_000_000
#: Words counted before a training task reports.
WORDS_HELD = 300_000


class Vocabulary(NamedTuple):
    """The model file's library object, its ordinary pieces with their numbers, and these as a trie in arrays.

    keys (sorted): a node's number * 2^21 + a character; child: the node that this leads to; piece: a node's piece, or -1.
    """

    model: object
    pieces: dict[str, int]
    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    longest: int


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    nodes = {h: k for k, h in enumerate(["", *sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)})])}
    links = sorted((nodes[h[:-1]] << 21 | ord(h[-1]), k) for h, k in nodes.items() if h)
    keys, child = (np.array(x, np.int64) for x in zip(*links, strict=True))
    return Vocabulary(model, pieces, keys, child, np.array([pieces.get(h, -1) for h in nodes], np.int64), max(map(len, pieces)))


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


COUNTED = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.int64())])


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """lang, piece, n over all rows of ``docs`` (lang, text)."""

    def report(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        ordinary = set(known.pieces.values())
        for lang, counter in words.items():
            total: Counter = Counter()
            # The library puts the mark before each word by itself.
            for n, ids in zip(counter.values(), known.model.encode(list(counter), num_threads=1), strict=True):
                for i in ids:
                    total[i] += n
            kept = [(i, n) for i, n in total.items() if i in ordinary]
            yield batch(COUNTED, [[lang] * len(kept), [i for i, _ in kept], [n for _, n in kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for langs, texts in columns_of(batches):
            for lang, text in zip(langs, texts, strict=True):
                words[lang].update(words_of(text))
                if sum(map(len, words.values())) > WORDS_HELD:
                    yield from report(words)
                    words.clear()
        yield from report(words)

    rows = docs.where(F.col("lang").isNotNull()).select(docs["lang"].cast("string").alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages, pieces that were counted, the probability of each in each language, and that of a piece never counted."""

    langs: list[str]
    pieces: np.ndarray
    p: np.ndarray
    floor: np.ndarray


class Scorer:
    """Log-probabilities of words under every language of a model, summed over all segmentations."""

    def __init__(self, path: str, model: Model) -> None:
        self.known = vocabulary(path)
        self.langs = model.langs
        #: The row of each piece in ``p``: row 0 is of pieces never counted, the last one of characters outside the vocabulary.
        self.row = np.zeros(self.known.model.get_piece_size(), np.int64)
        self.row[model.pieces] = np.arange(1, len(model.pieces) + 1)
        self.p = np.vstack([model.floor, model.p, np.full(len(model.langs), UNKNOWN)])
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(self.langs)))

    def cuts(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Every piece in every part: part, end, length, row of its probability; sorted by end and length."""
        keys, child, piece, longest = self.known.keys, self.known.child, self.known.piece, self.known.longest
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        letters = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.arange(len(letters))  # where a piece starts, over all parts
        who, node = np.repeat(np.arange(len(parts)), size), np.zeros(len(letters), np.int64)
        ends = first + size
        out = []
        for length in range(1, longest + 1):
            inside = at + length <= ends[who]
            at, who, node = at[inside], who[inside], node[inside]
            key = node << 21 | letters[at + length - 1]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = keys[found] == key
            if length == 1:
                single = np.where(there, piece[child[found]], -1)
                out.append((who, at + 1 - first[who], np.ones(len(at), np.int64), np.where(single >= 0, self.row[single], len(self.p) - 1)))
            at, who, node = at[there], who[there], child[found[there]]
            if length > 1:
                whole = piece[node] >= 0
                some = who[whole]
                out.append((some, at[whole] + length - first[some], np.full(len(some), length), self.row[piece[node[whole]]]))
            if not len(at):
                break
        who, end, length, row = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(end * (longest + 1) + length, kind="stable")
        return who[order], end[order], length[order], row[order]

    def forward(self, parts: list[str]) -> np.ndarray:
        """log P(part | language) of each part, with its mark."""
        who, end, length, row = self.cuts(parts)
        ring = self.known.longest + 1
        mass = np.zeros((ring, len(parts), len(self.langs)))
        mass[0] = 1
        scale, out = np.zeros(mass.shape[1:]), np.zeros(mass.shape[1:])
        borders = np.flatnonzero((end[1:] != end[:-1]) | (length[1:] != length[:-1])) + 1
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        last = np.argsort(size, kind="stable")
        over = np.searchsorted(size[last], np.arange(size.max() + 2)) if len(parts) else []
        for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(end)], strict=True):
            e, n, some = int(end[a]), int(length[a]), who[a:b]
            if n == 1:  # the shortest piece comes first: a new place
                mass[e % ring] = 0
            mass[e % ring, some] += mass[(e - n) % ring, some] * self.p[row[a:b]]
            if b == len(end) or end[b] != e:
                done = last[over[e] : over[e + 1]]
                out[done] = np.log(mass[e % ring, done]) + scale[done]
                if e % SCALED == 0:
                    most = mass.max(axis=0)
                    most[most == 0] = 1
                    mass /= most
                    scale += np.log(most)
        return out

    def room(self) -> int:
        """How many words are remembered: fewer where there are many languages."""
        return max(1, min(REMEMBERED, SCORES // max(1, len(self.langs))))

    def learn(self, words: set[str]) -> None:
        """Make the scores of ``words`` known."""
        if len(self.rows) + len(words) > self.room():
            self.rows, self.scores = {}, self.scores[:0].copy()
        new = [w for w in words if w not in self.rows]
        fresh, held, size = [], [], 0
        most = max(1, MASSES // ((self.known.longest + 1) * max(1, len(self.langs))))
        long = [w for w in new if len(w) > LONG]
        new = [w for w in new if len(w) <= LONG]
        for k, w in enumerate(new):
            held.append(BLANK + w)
            size += len(w)
            if size >= CHARACTERS or len(held) >= most or k + 1 == len(new):
                fresh.append(self.forward(held))
                held, size = [], 0
        fresh += [self.forward([BLANK + w]) for w in long]
        base = len(self.scores)
        self.scores = np.concatenate([self.scores, *fresh])
        self.rows.update((w, base + k) for k, w in enumerate(chain(new, long)))

    def totals(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """Place and log-probabilities of each text of words that has any."""
        step, held = 0, 0
        half = max(1, self.room() // 2)
        together = min(LOOKED_UP, half)
        for k, ws in enumerate(texts):  # a batch may hold more words than are looked up together
            held += len(ws)
            if k + 1 < len(texts) and held < together:
                continue
            some = [j for j in range(step, k + 1) if texts[j]]
            for j in some if held > half else ():  # one very long text: a slice at a time
                yield j, sum((self.sums([texts[j][a : a + together]])[0] for a in range(0, len(texts[j]), together)), np.zeros(len(self.langs)))
            if held <= half and some:
                yield from zip(some, self.sums([texts[j] for j in some]), strict=True)
            step, held = k + 1, 0

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        self.learn(set(chain.from_iterable(texts)))
        sizes = [len(ws) for ws in texts]
        which = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        return np.add.reduceat(self.scores[which], np.cumsum([0, *sizes[:-1]]))


_scorers: dict[str, Scorer] = {}


def scorer_of(name: str, path: str, sent: Broadcast) -> Scorer:
    """The worker's scorer of a model; the last one is kept, so that its known words serve later tasks."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(path, Model(*sent.value))
    return _scorers[name]


def train(docs: DataFrame, path: str) -> Iterator[Model]:
    """A model for each TOGETHER languages in order of their names; each has at most vocabulary x TOGETHER numbers."""
    counts = shared_table(piece_counts(docs, path), "pieces")
    size = len(vocabulary(path).pieces)
    names = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    for at in range(0, len(names), TOGETHER):
        langs = names[at : at + TOGETHER]
        rows = counts.where(F.col("lang").isin(langs)).toPandas()
        pieces, place = np.unique(rows["piece"].to_numpy(np.int64), return_inverse=True)
        n = np.zeros((len(pieces), len(langs)))
        n[place, np.searchsorted(np.array(langs), rows["lang"].to_numpy(str))] = rows["n"]
        total = n.sum(axis=0) + SMOOTH * size
        yield Model(langs, pieces, (n + SMOOTH) / total, SMOOTH / total)


STATE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("lang_pred", pa.string()), ("top", pa.float64()), ("all", pa.float64())])


def _scored(name: str, path: str, sent: Broadcast):
    """One model's turn: keeps each text's best language (``top`` its log-probability) and the sum of all so far (``all``, a logarithm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, path, sent)
        for ids, marks, texts, langs, tops, alls in columns_of(batches):
            for k, total in scorer.totals([words_of(t) for t in texts]):
                best = int(np.argmax(total))
                if langs[k] == UNDECIDED or total[best] > tops[k]:
                    langs[k], tops[k] = scorer.langs[best], float(total[best])
                alls[k] = float(np.logaddexp.reduce(total, initial=alls[k]))
            yield batch(STATE, [ids, marks, texts, langs, tops, alls])

    return run


UNDECIDED = "und"


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), lang_pred and score; learns from the rows not held out."""
    held = (F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held, docs["lang"].alias("lang"), text_or_empty().alias("text"))
    least = F.lit(float("-inf"))
    found = rows.select("doc_id", "held_out", "text", F.lit(UNDECIDED).alias("lang_pred"), least.alias("top"), least.alias("all"))
    for model in train(rows.where(~F.col("held_out")), path):
        sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most vocabulary x TOGETHER numbers
        found = found.mapInArrow(_scored(uuid.uuid4().hex, path, sent), "doc_id long, held_out boolean, text string, lang_pred string, top double, all double")
    return found.select("doc_id", "held_out", "lang_pred", F.when(F.col("lang_pred") == UNDECIDED, 0.0).otherwise(F.exp(F.col("top") - F.col("all"))).alias("score"))
