"""How far the sources of a language differ in their terms, with a frequent-pattern tree of term rows.

1. Each task counts terms by (lang, source) as it reads and hands on its sums; Spark adds
   them. Terms in at least ``least`` documents of their language are kept.
2. A kept term is a row: its nonzero counts in the order of the language's sources, and with each
   the source's scaled probability of the term and of a term it never uses. Equal rows
   are one row with a multiplicity.
3. Rows are dealt by range and sorted, so that rows with a common beginning meet. Each task inserts them
   into a frequent-pattern tree: a node is a beginning, its weight the multiplicities
   of the rows through it. As a branch is left, each of its nodes is met once with each ancestor and
   adds ``weight * correction`` to the pair of their sources. Cutting a branch at a border of tasks only
   splits its weight, so sums stay exact.
4. The sum over all terms of ``f(p, q)`` of two sources is: ``V`` terms that neither uses, plus for each
   source what its own terms change against the other's unused probability (from counts of equal
   probabilities), plus the corrections of terms that both use. The results are symmetric, so
   each pair is summed once.

Everything is integers; ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` is worked out in decimals, as counts may be large.

Defined results: null text, lang and source are ''; a row without terms still makes its (lang, source) a group; a language
without kept terms has value 0 for all pairs and no terms; repeated rows and rows that repeat an id count each;
an empty table gives an empty result; columns other than text, lang and source are not read. Texts are read in
pieces of ``PIECE`` bytes, cut between terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerion.llm.common import batch, shared_table, text_or_empty

LEAST, RANKS, SCALE = 10, 10, 1_000_000_000
#: Bytes of text whose terms are listed at once; sums held before they are handed on.
PIECE, HELD = 1 << 20, 200_000
#: Sums of source pairs that a tree holds before it hands them on.
HELD_PAIRS = 1 << 20
#: Meetings of a branch's nodes with their ancestors that are worked out at once.
CELLS = 1 << 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: In UTF-8: ASCII letters and all bytes of other characters.
TERM, OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut where no term goes on."""
    at = 0
    while at < len(text):
        cut = OTHER.search(text, min(len(text), at + PIECE))
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, df) in counts.items():
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), [t.decode() for t in n], n.values(), [df[t] for t in n]), strict=True):
                column.extend(values)
        counts.clear()
        return batch(COUNTED, columns)

    for b in batches:
        held = 0
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), strict=True):
            n, df = counts.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in pieces(text.as_py().translate(LOWER)):
                terms = TERM.findall(piece)
                n.update(terms)
                own.update(terms)
            df.update(own)
            held += len(own)
            if held > HELD:
                held = 0
                if sum(len(n) for n, _ in counts.values()) > HELD:
                    yield told()
    if counts:
        yield told()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents)."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(_count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _p(count, total, terms):
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms))


def _f(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


#: A step of a row: the source's number, its scaled probability of the term, and of a term it never uses.
PATH = pa.list_(pa.struct([("s", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))
PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("both", pa.int64())])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Tree:
    """The branch of a frequent-pattern tree that rows in order are being inserted into.

    Rows come sorted, so a node that the next row doesn't share is complete: it is met with
    its ancestors, then forgotten. Memory is the longest row and the sums.
    """

    def __init__(self) -> None:
        self.steps: list[tuple[int, int, int]] = []
        self.weights: list[int] = []
        self.sums: dict[int, np.ndarray] = {}
        self.nodes = self.held = 0

    def insert(self, path: list[tuple[int, int, int]], weight: int) -> None:
        shared = 0
        while shared < min(len(path), len(self.steps)) and path[shared] == self.steps[shared]:
            shared += 1
        self.close(shared)
        self.steps += path[shared:]
        self.weights += [0] * (len(path) - shared)
        for i in range(len(path)):
            self.weights[i] += weight

    def close(self, to: int = 0) -> None:
        """Leaves the nodes below depth ``to``: each meets each of its ancestors, once; a branch's nodes together."""
        if to >= len(self.steps):
            return
        s, p, p0 = np.array(self.steps, np.int64).T
        n, weights = len(s), np.array(self.weights, np.int64)
        self.nodes += n - to
        most = max(1, CELLS // n)
        for a in range(to, n, most):
            b = min(n, a + most)
            own_p, own_p0, over_p, over_p0 = p[a:b, None], p0[a:b, None], p[: b - 1], p0[: b - 1]
            fixed = divergence(over_p, own_p) - divergence(over_p, own_p0) - divergence(over_p0, own_p) + divergence(over_p0, own_p0)
            fixed *= weights[a:b, None]
            for i in range(a, b):
                own = self.sums.get(int(s[i]))
                if own is None:  # ancestors have smaller numbers
                    own = self.sums[int(s[i])] = np.zeros(int(s[i]), np.int64)
                    self.held += len(own)
                own[s[:i]] += fixed[i - a, :i]
        del self.steps[to:], self.weights[to:]

    def drain(self, lang: str) -> pa.RecordBatch:
        """The sums so far, by source pair; the open branch goes on."""
        found = [(int(a), b, int(own[a])) for b, own in self.sums.items() for a in np.flatnonzero(own)]
        self.sums, self.held = {}, 0
        return batch(PAIRS, [[lang] * len(found), *([r[i] for r in found] for i in range(3))])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, lang = Tree(), None
    for b in batches:
        paths = b.column(1)
        steps, ends = paths.flatten(), paths.offsets.to_pylist()
        flat = list(zip(*(steps.field(i).to_pylist() for i in range(3)), strict=True))
        begin = ends[0]
        for i, (of, weight) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if of != lang or tree.held > HELD_PAIRS:
                if of != lang:
                    tree.close()
                if lang is not None:
                    yield tree.drain(lang)
                lang = of
            tree.insert(flat[ends[i] - begin : ends[i + 1] - begin], weight)
    tree.close()
    if lang is not None:
        yield tree.drain(lang)


def corrections(rows: DataFrame) -> DataFrame:
    """lang, a, b, both: what terms that both sources use change, from ``(lang, path, weight)``; a < b."""
    ordered = rows.where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return ordered.mapInArrow(_grow, "lang string, a int, b int, both long").groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, q, p, f summed or alone (value), and rank of every pair of sources and of the terms that stand out."""
    named = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    groups = shared_table(named.withColumn("s", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")), "sources")
    counts = term_counts(docs).join(groups, ["lang", "source"])
    row = F.array_sort(F.collect_list(F.struct("s", "n")))
    terms = shared_table(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), row.alias("row")).where(F.col("df") >= least), "terms")

    used = terms.select("lang", F.explode("row").alias("c")).groupBy("lang", "c.s").agg(F.sum("c.n").alias("total"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    zero = F.lit(0).cast("long")
    sized = groups.join(used, ["lang", "s"], "left").join(vocabulary, "lang", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("total", "v", "whole")})
    sources = shared_table(sized.withColumn("p0", F.when(F.col("v") > 0, _p(zero, F.col("total"), F.col("v")))), "sized")

    # One row a language: its sources' totals in their order.
    langs = sources.groupBy("lang", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "total", "p0"))), lambda x: F.struct(x["total"].alias("total"), x["p0"].alias("p0"))).alias("all"))
    step = lambda c, every, v: F.struct(c["s"].alias("s"), _p(c["n"], F.get(every, c["s"])["total"], v).alias("p"), F.get(every, c["s"])["p0"].alias("p0"))
    paths = terms.join(langs, "lang").select("lang", "term", "n", F.transform("row", lambda c: step(c, F.col("all"), F.col("v"))).alias("path"))
    rows = shared_table(paths.groupBy("lang", "path").agg(F.count("*").alias("weight")), "rows")

    # What a source's own terms change against each other source's unused probability: one row for equal probabilities.
    alone = rows.select("lang", F.explode("path").alias("c"), "weight").groupBy("lang", "c.s", "c.p", "c.p0").agg(F.sum("weight").alias("weight"))
    other = sources.select("lang", F.col("s").alias("o"), F.col("p0").alias("o0"))
    gap = F.sum(F.col("weight") * (_f(F.col("p"), F.col("o0")) - _f(F.col("p0"), F.col("o0"))))
    single = alone.join(other, "lang").where("s <> o").groupBy("lang", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(gap.alias("single"))

    side = lambda n: sources.select("lang", "v", F.col("s").alias(n), F.col("source").alias(f"source_{n}"), F.col("p0").alias(f"p0_{n}"))
    pairs = side("a").join(side("b").drop("v"), "lang").where("a < b").join(single, ["lang", "a", "b"], "left").join(corrections(rows), ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * _f(F.col("p0_a"), F.col("p0_b")) + F.coalesce("single", zero) + F.coalesce("both", zero)).otherwise(zero)
    told = pairs.select("lang", "source_a", "source_b", value.alias("value"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pair = told.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    flat = terms.select("lang", "term", "n", F.explode("row").alias("c")).select("lang", "term", F.col("n").alias("q_n"), "c.s", F.col("c.n").alias("n")).join(sources.drop("p0"), ["lang", "s"])
    over = flat.withColumn("p", _p(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", _p(F.col("q_n"), F.col("whole"), F.col("v"))).where("p > q")
    term = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
    return pair.withColumn("rank", F.row_number().over(by)).unionByName(best)


#: DuckDB text over ``documents``: every term of every pair of sources.
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ps AS (SELECT lang, source, term, n, CAST(1 + {SCALE} * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS HUGEINT) AS p FROM cells WINDOW g AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
qs AS (SELECT lang, term, CAST(1 + {SCALE} * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS HUGEINT) AS q FROM whole WINDOW g AS (PARTITION BY lang)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
