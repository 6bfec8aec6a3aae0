"""License scans: fuzzy search for short notices.

A notice within ``e`` edits of a place in the text, cut into ``e + 1`` pieces,
keeps one piece unchanged there (pigeonhole). One automaton finds
all pieces of all notices in one pass; around each hit, the regex library's
bounded-error matching verifies the notice and reports the spans of all its places.
Places begin and end with a word, and the word that tells a notice from others (``gnu``, ``mit``)
must be there itself, with one edit in each three of its letters at most: ``the general public license`` is no
notice. Where places of notices with different labels overlap, the one with fewest edits stays.
Exact places of the base phrases are counted on the words themselves.

Defined results: a null or empty text has no words, no places, empty label
lists and score 0; rows that repeat are scanned one by one; other
columns are not read; an empty table gives an empty result; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, text_or_empty

# The phrases whose exact places count, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices searched with edits, their labels, the edits allowed, and the words that must be there.
NOTICES = (
    ("gnu general public license", "gpl", 3, "gnu"),
    ("gnu lesser general public license", "lgpl", 3, "lesser"),
    ("gnu affero general public license", "agpl", 3, "affero"),
    ("apache license version 2 0", "apache", 3, "apache"),
    ("licensed under the apache license", "apache", 3, "apache"),
    ("released under the mit license", "mit", 3, "mit"),
    ("permission is hereby granted free of charge to any person", "mit", 6, "permission"),
    ("redistribution and use in source and binary forms", "bsd", 5, "redistribution"),
    ("mozilla public license", "mpl", 2, "mozilla"),
    ("licensed under cc by", "cc-by", 2, "cc by"),
    ("creative commons attribution", "cc-by", 3, "creative commons"),
    ("all rights reserved", "reserved", 2, "reserved"),
)
#: Letters of a notice's own word for each edit in it.
LETTERS = 3

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Found(NamedTuple):
    """A notice in the words joined by blanks: label, edits, notice length, span in characters."""

    label: str
    edits: int
    size: int
    start: int
    end: int


def bounded(phrase: str, edits: int) -> str:
    """A pattern for ``phrase`` within ``edits``, from the begin of a word to the end of one."""
    return f"(?<![^ ])(?:{regex.escape(phrase, special_only=True)}){{e<={edits}}}(?![^ ])"


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of a notice with their offsets, of lengths as even as can be."""
    k = edits + 1
    cuts = [i * len(notice) // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _matchers():
    import ahocorasick

    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, edits, _) in enumerate(NOTICES):
        for at, piece in seeds(notice, edits):
            pieces.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, places in pieces.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    fuzzy = [bounded(notice, edits) for notice, _, edits, _ in NOTICES]
    own = [regex.compile(bounded(word, len(word) // LETTERS)) for *_, word in NOTICES]
    return automaton, [(regex.compile(f), regex.compile("(?b)" + f)) for f in fuzzy], own


def places_in(joined: str, lo: int, hi: int, patterns: tuple, reach: int) -> Iterator[regex.Match]:
    """The places of one notice from ``lo`` to ``hi`` that do not overlap, from left to right.

    ``patterns`` find the leftmost place and the one with fewest edits. Of the places that overlap the
    leftmost one (a place has ``reach`` characters at most), the best is taken, or a better one that overlaps that;
    what lies before and behind it is searched again.
    """
    first, best = patterns
    before = lambda at: max(0, at - 1)  # noqa: E731 the library puts no letter in where a search starts
    while m := first.search(joined, before(lo), hi):
        b = m
        while (c := best.search(joined, before(m.start()), min(hi, b.end() + reach))) and sum(c.fuzzy_counts) < sum(b.fuzzy_counts):
            b = c
        yield from places_in(joined, m.start(), b.start(), patterns, reach)
        yield b
        lo = b.end()


def every_notice(joined: str) -> list[Found]:
    """All notices in words joined by single blanks; places of one notice do not overlap."""
    automaton, patterns, own = _matchers()
    joined = " " + joined
    areas: list[list[tuple[int, int]]] = [[] for _ in NOTICES]
    for end, (size, places) in automaton.iter(joined):
        for i, at in places:
            notice, _, edits, _ = NOTICES[i]
            a = end + 1 - size - at
            lo, hi = max(0, a - edits), min(len(joined), a + len(notice) + edits)
            if areas[i] and lo <= areas[i][-1][1]:
                areas[i][-1] = (min(lo, areas[i][-1][0]), max(hi, areas[i][-1][1]))
            else:
                areas[i].append((lo, hi))
    out = []
    for (notice, label, edits, _), pattern, word, where in zip(NOTICES, patterns, own, areas, strict=True):
        for lo, hi in where:
            for m in places_in(joined, lo, hi, pattern, len(notice) + edits):
                if word.search(joined, m.start() - 1, m.end()):
                    out.append(Found(label, sum(m.fuzzy_counts), len(notice), m.start() - 1, m.end() - 1))
    return out


def notices_in(joined: str) -> list[Found]:
    """All notices, in text order, without those that overlap one of another label with fewer edits (or as many, and longer)."""
    stay: list[Found] = []
    for f in sorted(every_notice(joined), key=lambda f: (f.start, f.end)):
        # Places are short, so only the last few can reach into the next one.
        rivals = [g for g in stay[-len(NOTICES) :] if g.label != f.label and g.end > f.start]
        better = lambda a, b: (a.edits, -a.size) < (b.edits, -b.size)
        if any(not better(f, g) for g in rivals):
            continue
        for g in rivals:
            stay.remove(g)
        stay.append(f)
    return stay


def base_places(joined: str) -> list[tuple[int, str]]:
    """(word number, label) of each exact place of a phrase."""
    padded = f" {joined} "
    out = []
    for phrase, label in PHRASES.items():
        at, seen, words = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            words, seen = words + padded.count(" ", seen, at), at
            out.append((words, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.string())),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in columns_of(batches):
        rows = []
        for i, text in zip(ids, texts, strict=True):
            words = WORD.findall(text.translate(LOWER))
            joined = " ".join(words)
            base, found = base_places(joined), notices_in(joined)
            places, named = [w for w, _ in base], {label for _, label in base}
            score = 1.0 if base else max((1 - f.edits / f.size for f in found), default=0.0)
            rows.append((
                i, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(named)),
                ",".join(sorted(named | {f.label for f in found})), score, [f"{f.label}:{f.start}-{f.end}:{f.edits}" for f in found],
            ))
        yield batch(SCAN, list(zip(*rows, strict=True)) if rows else [[] for _ in SCAN])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; spans are ``label:start-end:edits`` in the words joined by blanks."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")


def base(docs: DataFrame) -> DataFrame:
    """What ``scan`` says of the base phrases alone; without a place, first and last are -1."""
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    return scan(docs).select("doc_id", "n_words", "n_base", none("first_word"), none("last_word"), "base_labels")


def _sql() -> str:
    """DuckDB text of ``base`` over ``documents``: the places whose word and next ones are a phrase's."""
    same = lambda phrase: " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    lists = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: {same(phrase)}) AS p{k}" for k, phrase in enumerate(PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
placed AS (SELECT doc_id, len(ws) AS n, {lists} FROM words),
found AS (SELECT doc_id, n, {every} AS places, list_sort(list_filter([{named}], lambda x: x IS NOT NULL)) AS named FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(coalesce(list_min(places) - 1, -1) AS BIGINT) AS first_word,
  CAST(coalesce(list_max(places) - 1, -1) AS BIGINT) AS last_word, array_to_string(named, ',') AS base_labels FROM found
"""


#: The base columns' SQL; bounded-error search can't be said in it.
BASE_ORACLE = _sql()
