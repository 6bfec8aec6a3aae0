"""SimHash groups against fingerprints and distances by plain loops."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from numerion.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, component_id string"


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(prints):
    """(id, hex, component) of every (id, print): reachability over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, f"{p:016x}", least[find(i)], d == least[find(i)]) for i, (d, p) in enumerate(prints)]


def awkward(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeFé日") for _ in range(r.randint(1, 6))) for _ in range(200)]
    base = [r.choice(words) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x" * 5000), (None, "one two"), (None, "alone here now then"), (3, "one\x0btwo three four"), (7, " ".join(base * 40))]
    for i in range(8, n):
        ws = list(base)
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(len(ws))] = r.choice(words)
        rows.append((i, r.choice([" ".join(ws), " ".join(ws).upper(), " ".join(r.choice(words) for _ in range(r.randint(1, 60)))])))
    return rows


key = lambda rows: sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_groups_equal_brute_force(spark, most):
    rows = awkward(3, 140)
    df = spark.createDataFrame([(d, t, None, "a", 1, "x", 2, "y") for d, t in rows], SCHEMA).repartition(3)
    got = simhash.near_duplicates(df, most=most).collect()
    want = brute([(d, brute_print(t)) for d, t in rows])
    assert key(got) == key(want)
    assert len({c for _, _, c, _ in want}) < len(rows) - 20


@pytest.mark.parametrize("most", [1, 5, 64, 10**6])
def test_every_way_to_differ_is_found(spark, most):
    """Prints one to three bits apart, anywhere, in crowded neighbourhoods: components equal those of all pairs."""
    r = random.Random(9)
    prints = {0, 2**64 - 1, 1 << 63, 1 << 31, 3 << 62}
    for _ in range(6):
        centre = r.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4]))) for _ in range(60)}
        low = {centre ^ r.getrandbits(5) << r.choice([0, 20, 30, 40, 59]) for _ in range(30)}
        prints |= {p % 2**64 for p in low}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most).collect()
    assert all(((u % 2**64) ^ (v % 2**64)).bit_count() <= 2 for u, v in links)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in links:
        root[max(find(u % 2**64), find(v % 2**64))] = min(find(u % 2**64), find(v % 2**64))
    want = {d: c for d, _, c, _ in brute([(p, p) for p in prints])}
    assert {p: find(p) for p in prints} == want
    assert len(set(want.values())) > 6


def test_crowded_keys_make_few_rows(spark):
    """4,000 prints in one key: rows grow with their number, not with its square."""
    r = random.Random(2)
    prints = {r.getrandbits(24) for _ in range(4000)}
    assert simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).count() <= 65 * len(prints)


def test_keys_are_sent_whole_to_nobody(spark, monkeypatch):
    """34 keys a print: a table that Spark takes for small, as it sizes exploded rows by the rows they come from."""
    plans, stored = [], simhash.shared_table

    def told(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(simhash, "shared_table", told)
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(9)), None, "a", 1, None, 1, "") for i in range(50)], SCHEMA)
    out = simhash.near_duplicates(docs)
    plans.append(("out", out._jdf.queryExecution().sparkPlan().toString()))
    joined = {name: plan for name, plan in plans if "Join" in plan}
    assert set(joined) == {"keys", "named", "out"}
    assert "BroadcastHashJoin" not in joined["keys"] + joined["named"]
    assert joined["out"].count("BroadcastHashJoin") == 2  # classes of more than a part in HOT of all rows


def test_pieces_do_not_change_prints(monkeypatch):
    texts = [t.encode() for _, t in awkward(5, 60) if t]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t) for t in texts] == whole == [p - 2**64 if (p := brute_print(t.decode())) >= 2**63 else p for t in texts]


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id", "kept"] and out.count() == 0


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert key(simhash.near_duplicates(docs).collect()) == key(brute([(d, brute_print(t)) for d, t in rows]))
