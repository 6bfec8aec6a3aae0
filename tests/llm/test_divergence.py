"""Source divergence through the tree of term rows against plain sums over all terms."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import pytest

from numerion.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, s int"


def brute(rows, least):
    docs = [(lang or "", source or "", [t for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, ts in docs:
            if g == lang:
                groups[s].update(t for t in ts if t in set(kept))
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pair = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in groups.items() if o != s]
            term = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", term, 10)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def awkward(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeXYZéß日") for _ in range(r.randint(1, 3))) for _ in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = []
    for _ in range(n):
        source = r.choice(["a", "a", "a", "b", "ç", None, "", "only"])
        text = r.choice([" ", "\n", "7", "-"]).join(r.choices(words, weights, k=r.randint(0, 40)))
        rows.append((text, r.choice(["en", "en", "de", None, ""]), source))
    rows += [(None, "en", "null text"), ("", "en", "no text"), ("123 ... 456", "xx", "no terms"), ("one two", "yy", "u"), ("one", "yy", "v"), ("word " * 3000, "en", "a"), rows[0], rows[0]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, *row, None, "x", 1, 2) for i, row in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "n", "least"), [(1, 150, 3), (2, 60, 10), (3, 20, 1)])
def test_audit_equals_brute_force(spark, seed, n, least):
    rows = awkward(seed, n)
    got = divergence.audit(frame(spark, rows), least=least).collect()
    assert sorted(map(tuple, got)) == brute(rows, least)


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_pieces_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = "ab cde fghijklmn é日x 12 zz".encode()
    assert [t for p in divergence.pieces(text) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)
    assert len(list(divergence.pieces(text))) > 2


def test_tree_meets_each_shared_node_once():
    """Sums equal those over all rows and pairs; rows with common beginnings share nodes; draining in between changes nothing."""
    r = random.Random(4)
    rows = sorted({tuple((s, r.choice([5, 9]), 2) for s in sorted(r.sample(range(6), r.randint(2, 6)))) for _ in range(150)})
    weights = [r.randint(1, 5) for _ in rows]
    tree, got = divergence.Tree(), Counter()

    def drain():
        told = tree.drain("x")
        got.update({(a, b): v for a, b, v in zip(*(told.column(i).to_pylist() for i in (1, 2, 3)), strict=True)})

    for k, (row, w) in enumerate(zip(rows, weights, strict=True)):
        tree.insert(list(row), w)
        if k % 17 == 0:
            drain()
    tree.close()
    drain()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for row, w in zip(rows, weights, strict=True):
        for (a, p, p0), (b, q, q0) in combinations(row, 2):
            want[a, b] += w * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert tree.nodes == len({row[: k + 1] for row in rows for k in range(len(row))}) < 0.7 * sum(map(len, rows))


@pytest.mark.parametrize("cells", [1 << 16, 90, 1])
def test_nodes_of_a_branch_meet_their_ancestors_together(monkeypatch, cells):
    """As few array steps as the cells allow, not some for each node; the sums are those of single pairs."""
    plain, calls = divergence.divergence, []
    monkeypatch.setattr(divergence, "divergence", lambda p, q: calls.append(1) or plain(p, q))
    monkeypatch.setattr(divergence, "CELLS", cells)
    r = random.Random(8)
    row = [(2 * i, r.randint(1, 10**9), r.randint(1, 1000)) for i in range(30)]
    tree = divergence.Tree()
    tree.insert(row, 3)
    tree.close()
    assert len(calls) == 4 * -(-30 // max(1, cells // 30))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = {(a, b): 3 * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) for (a, p, p0), (b, q, q0) in combinations(row, 2)}
    assert {(a, b): int(own[a]) for b, own in tree.sums.items() for a in range(0, b, 2)} == want and tree.nodes == 30


def test_sums_are_handed_on_before_they_grow(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    b = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "a", "b", "a"]), pa.array([b"x y z", b"p q x", b"x", b"x X"])], names=["lang", "source", "text"])
    told = list(divergence._count(iter([b])))
    assert len(told) > 1
    sums = Counter()
    for t in told:
        for source, term, n, df in zip(*(t.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            sums.update({(source, term, "n"): n, (source, term, "df"): df})
    assert sums["a", "x", "n"] == 4 and sums["a", "x", "df"] == 3 and sums["b", "x", "n"] == 1


def test_sql_equals_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = divergence.audit(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE}) q").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want
