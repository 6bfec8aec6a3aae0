"""Each operator against a brute-force version, on small fixtures with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from numerion.llm import bpe_chunks, chat_quotes, graph, langid, license_scan, minhash, mixing, oracles, quality, suffix_dedup, token_counts, topk
from numerion.llm.common import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, in_text string, cls string, ord long, span string"


def awkward_texts(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Nulls, empties, copies, near copies, shared passages, periodic and long texts, odd characters."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(200)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = prose(60)
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "ab" * 400), (4, "x" * 300), (5, passage), (6, passage[:90]), (7, "日本語 テキスト " * 40)]
    base = prose(150)
    for i in range(8, n):
        kind = r.randrange(6)
        if kind == 0:
            ws = base.split()
            for _ in range(r.randint(0, 12)):
                ws[r.randrange(len(ws))] = r.choice(words)
            out.append((i, " ".join(ws)))
        elif kind == 1:
            out.append((i, prose(20) + "\n" + passage + "\n" + prose(10)))
        elif kind == 2:
            out.append((i, out[r.randrange(len(out))][1]))
        elif kind == 3:
            out.append((i, "\n".join([prose(8)] * 4 + [prose(5)])))
        else:
            out.append((i, prose(r.randint(1, 200))))
    out.append((n, prose(8000)))
    return out


def frame(spark, rows):
    full = [(d, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), None, "x", "y", 1, "z") for (d, t), r in ((row, random.Random(str(row[0]))) for row in rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def plain_rows(df, columns):
    return sorted(repr([None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in df[columns].astype(object).values.tolist())


# 1 ----------------------------------------------------------------------------------------------


def removed_by_hand(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(docs, rows):
    got = {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in collected(suffix_dedup.report(docs)).items()}
    want = removed_by_hand(rows)
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_suffix_dedup_deals_hot_minimizers_and_segments(docs, rows, monkeypatch):
    want = removed_by_hand(rows)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in collected(suffix_dedup.report(docs)).items()}
    assert got == want


def test_suffix_dedup_bounds_what_a_task_compares(spark, monkeypatch):
    """A passage in every text, with other words on both sides: its edges share minimizers, and no task holds them all."""
    r = random.Random(8)
    letters = lambda k: "".join(r.choices("abcdefgh ", k=k))
    passage = letters(400)
    rows = [(i, letters(150) + passage[: 400 - i % 3] + letters(150)) for i in range(300)]
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    monkeypatch.setattr(suffix_dedup, "MANY", 40)
    many = []
    by_hash = suffix_dedup._spans_by_hash
    monkeypatch.setattr(suffix_dedup, "_spans_by_hash", lambda contents, length: many.append(contents.count()) or by_hash(contents, length))
    got = {d: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for d, x in collected(suffix_dedup.report(frame(spark, rows).repartition(5))).items()}
    assert got == removed_by_hand(rows) and many[0] > 40


def test_segments_of_a_long_text_cover_every_window():
    data = bytes(random.Random(1).choices(b"ab", k=1000))
    seen = set()
    for at in range(0, len(data) - 99, 300):
        piece = data[at : at + 399]
        _, a, b, _ = suffix_dedup.runs(np.frombuffer(piece, np.uint8), 32, 100)
        for x, y in zip(a, b, strict=True):
            seen |= set(range(at + x, at + y))
    assert seen == set(range(901))


@pytest.mark.parametrize("text", [b"abaababaab", b"a" * 70, bytes(random.Random(3).choices(b"ab", k=300)), b"abc" * 40 + b"ab" * 30])
def test_previous_factor_by_hand(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:], strict=False)) if x != y), min(len(text) - a, len(text) - b))
    common = [0] + [share(a, b) for a, b in zip(order, order[1:], strict=False)]
    want = [max((share(i, j) for j in range(i)), default=0) for i in range(len(text))]
    for least in (1, 5, 30):
        got = suffix_dedup.previous_factor(np.array(order), np.array(common), np.arange(len(text)), least)
        assert got.tolist() == [w if w >= least else 0 for w in want]


def test_many_surroundings_of_one_string_stay_in_bounds():
    """20,000 runs around one string: no round of the pointers, and no sort, goes over more than the windows themselves."""
    r = random.Random(5)
    middle = bytes(r.choices(b"abcdefgh", k=80))
    rows = [(i, 0, 0, r.randbytes(15) + middle + r.randbytes(15)) for i in range(20_000)]
    tracemalloc.start()
    who, offset = suffix_dedup.later_windows([*rows, (30_000, 0, 0, rows[7][3])], 100)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert set(who.tolist()) == {20_000} and sorted(offset.tolist()) == list(range(11)) and most < 600e6


def test_suffix_dedup_with_null_ids_and_repeated_rows(spark, nothing):
    t = "".join(random.Random(4).choices("abcdef ", k=250))
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.report(frame(spark, [(5, t), (5, t), (7, t), (None, "q" + t)])).collect())
    assert got == [("5", 250), ("5", 250), ("7", 250), ("None", 0)]  # the null id comes first
    assert suffix_dedup.report(nothing).count() == 0


def test_cleaned_text_is_valid(docs, rows):
    got = {r["doc_id"]: r["clean_text"] for r in suffix_dedup.cleaned(docs, keep=("in_text",)).collect()}
    assert got[0] == "" and set(got) == {d for d, _ in rows}


# 2 ----------------------------------------------------------------------------------------------


def replies_by_hand(messages):
    """The newest earlier message of the conversation that holds the outermost matching quote."""

    def parse(text):
        out = []
        for line in (text or "").split("\n"):
            marks = re.match(r"^[ \t]*((?:>[ \t]?)+)", line)
            level = marks[1].count(">") if marks else 0
            if re.match(chat_quotes.ANNOUNCED, line):
                level = -1
            body = line[marks.end() :] if marks and level > 0 else line
            if out and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
        return out

    normal = lambda x: re.sub(r"\s+", " ", x.lower()).strip(" ")
    links = {}
    for conv, turn, _, text in messages:
        best = None
        for level, lines in parse(text):
            if level < 1:
                continue
            for whole, t in [(True, normal("\n".join(lines))), *((False, normal(x)) for x in lines)]:
                if not t:
                    continue
                for c2, t2, _, x2 in messages:
                    if c2 != conv or t2 is None or turn is None or t2 >= turn:
                        continue
                    own = [ls for lv, ls in parse(x2) if lv == 0]
                    if t in {normal("\n".join(ls)) for ls in own} | {normal(x) for ls in own for x in ls}:
                        best = max(best, (-level, whole, t2)) if best else (-level, whole, t2)
        links[conv, turn] = best[2] if best else None
    return links


def test_quotes_link_to_the_newest_earlier_message(spark, monkeypatch):
    monkeypatch.setattr(chat_quotes, "RANGE", 3)
    r = random.Random(8)
    lines = [f"line {i} says   Something" for i in range(12)]
    messages = []
    for conv in range(4):
        for turn in range(12):
            text = []
            for _ in range(r.randint(0, 3)):
                text.append(r.choice(["", "> ", ">> ", ">>> ", "> > "]) + r.choice(lines))
            text.append(r.choice(["", "On Monday A wrote:", *lines]))
            messages.append((conv, turn, r.choice(["user", None]), "\n".join(text)))
    messages += [(9, 0, None, None), (9, 1, "user", ""), (9, None, "user", "> line"), (None, 3, "user", "a")]
    df = spark.createDataFrame([(*m, "x", 1) for m in messages], "conv_id long, turn long, role string, text string, root string, h1 long")
    got = {(x["conv_id"], x["turn"]): x for x in chat_quotes.link_quotes(df).collect()}
    want = replies_by_hand([m for m in messages if m[0] is not None])
    assert {k: v["reply_to"] for k, v in got.items() if k[0] is not None} == want
    assert any(want.values())
    for (conv, turn), x in got.items():
        at, steps = turn, 0
        while want.get((conv, at)) is not None:
            at, steps = want[conv, at], steps + 1
        assert (x["root"], x["depth"]) == (at, steps)
        assert not re.search(r"^\s*>", x["body"] or "", re.M)
    below = {}
    for (conv, turn), to in want.items():
        if turn is not None:
            below.setdefault((conv, to), []).append(turn)
    read = lambda conv, turn: [turn] + [x for t in sorted(below.get((conv, turn), [])) for x in read(conv, t)]
    for conv in range(4):
        for root in below[conv, None]:
            thread = sorted((x["position"], x["turn"]) for (c, _), x in got.items() if c == conv and x["root"] == root)
            assert [t for _, t in thread] == read(conv, root) and [p for p, _ in thread] == list(range(len(thread)))
    assert chat_quotes.formatted(df).count() == len(messages)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = chat_quotes.link_quotes(df).columns
    plain = lambda rows: sorted(repr([None if v != v else int(v) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.CHAT_QUOTES})").fetchall()) == plain(map(tuple, got.values()))


def test_a_long_chain_of_replies_and_thousands_of_threads(spark):
    """A chain deeper than RANGE would show, and quoting conversations dealt over partitions, linked as they were made."""
    chain = [(0, t, "user", f"line {t}" if t == 0 else f"> line {t - 1}\nline {t}") for t in range(300)]
    fan = [(c, t, "user", f"first {c}" if t == 0 else f"> first {c}\nreply {t}") for c in range(1, 1500) for t in range(3)]
    df = spark.createDataFrame(chain + fan, "conv_id long, turn long, role string, text string").repartition(7)
    got = {(x["conv_id"], x["turn"]): x for x in chat_quotes.link_quotes(df).collect()}
    assert all((got[0, t]["root"], got[0, t]["depth"], got[0, t]["position"]) == (0, t, t) for t in range(300))
    assert all((got[c, t]["reply_to"], got[c, t]["position"], got[c, t]["n_linked"]) == (0 if t else None, t, int(t > 0)) for c in range(1, 1500) for t in range(3))


def test_quotes_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_quotes.link_quotes(empty).count() == 0


# 3 ----------------------------------------------------------------------------------------------


ODD = ["", " ", "  a  b ", "\n\n", "日本語テキスト", "a▁b", "<s> hi </s>", "<0x0A><unk>", "x" * 500, "\t\ta", "é́😀😀", "a\x00b", "....!!!???", "////----====", "0123456789" * 9]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(docs, rows, nothing, pieces):
    path = tokenizer("piece_bpe_32k.model")
    got = collected(token_counts.counts(docs, path, 300))
    for d, t in rows:
        n = len(pieces.encode(t or ""))
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((t or "").encode()), n, n > 300)
    assert token_counts.counts(nothing, path).count() == 0


def test_every_prefix_and_every_budget(pieces):
    c = token_counts.counter(tokenizer("piece_bpe_32k.model"))
    r = random.Random(5)
    odd = [*ODD, *("".join(r.choice("ab ▁\n.é😀thein") for _ in range(r.randint(1, 40))) for _ in range(60))]
    for text in odd:
        want = [len(pieces.encode(text[:k])) for k in range(len(text) + 1)]
        assert c.every_prefix(text).tolist() == want
        for budget in (0, 1, 3, 9):
            assert token_counts.fit(c.every_prefix(text), budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_prefix_table_answers_cuts_and_budgets(docs, rows, nothing, pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "SENT", 50)
    path = tokenizer("piece_bpe_32k.model")
    table = token_counts.prefix_table(docs, path).cache()
    got = {r["doc_id"]: r["chars"] for r in token_counts.within(table, 20).collect()}
    cut = {r["doc_id"]: r["n_tokens"] for r in token_counts.tokens_of(table, 33).collect()}
    for d, t in rows:
        t = t or ""
        assert cut[d] == len(pieces.encode(t[:33]))
        assert len(pieces.encode(t[: got[d]])) <= 20
        assert all(len(pieces.encode(t[:k])) > 20 for k in range(got[d] + 1, min(len(t), got[d] + 60) + 1))
    assert {r["chars"] for r in token_counts.within(table, -1).collect()} == {None}
    assert token_counts.prefix_table(nothing, path).count() == 0


# 4 ----------------------------------------------------------------------------------------------


def test_license_scan(spark, nothing):
    texts = {
        1: "This is under the MIT License.",
        2: "GNU General\nPublic, License! and gnu general public license",
        3: "released under the mitt licence terms",
        4: "Apache Licence, Version 2.0",
        5: None,
        6: "",
        7: "cc by cc by-nc 4.0",
        8: "permission is herby granted, free of charge, to any persn",
        9: "nothing here about anything, general or public",
        10: "mit  licenses",
    }
    got = collected(license_scan.scan(frame(spark, list(texts.items()))))
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (1, 4, "mit", 1.0)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 0, 5, "gpl")
    assert (got[3]["n_base"], got[3]["labels"]) == (0, "mit") and 0.8 < got[3]["score"] < 1
    assert got[4]["labels"] == "apache" and got[4]["base_labels"] == ""
    assert all((got[d]["n_words"], got[d]["labels"], got[d]["score"], got[d]["first_word"]) == (0, "", 0.0, None) for d in (5, 6))
    assert (got[7]["n_base"], got[7]["first_word"], got[7]["last_word"]) == (2, 0, 2)
    assert got[8]["labels"] == "mit" and got[9]["labels"] == "" and got[10]["n_base"] == 0
    assert license_scan.scan(nothing).count() == 0


def test_every_place_of_a_notice_is_reported(spark):
    text = "GNU General Public License and gnu general public license"
    got = collected(license_scan.scan(frame(spark, [(1, text), (2, "All rights reserved. " * 1000)])))
    assert got[1]["spans"] == ["gpl:0-26:0", "gpl:31-57:0"]
    assert got[2]["spans"] == [f"reserved:{20 * i}-{20 * i + 19}:0" for i in range(1000)]


def test_spans_equal_planted_notices():
    """Notices with edits, close to each other and far: as many spans as a search of the whole text gives, each over its notice."""
    r = random.Random(12)
    for notice, label, edits, word in license_scan.NOTICES:
        parts, places, at = [], [], 0
        for _ in range(60):
            x = list(notice)
            own = range(notice.index(word) - 1, notice.index(word) + len(word) + 1)
            for _ in range(r.randint(0, edits // 2)):
                k = r.randrange(len(x))
                x[k] = x[k] if k in own or x[k] == " " else "q"
            gap = " " + "zz " * r.randint(0 if r.random() < 0.5 else 5, 9)
            places.append((at, at + len(x), sum(a != b for a, b in zip(x, notice, strict=True))))
            parts += ["".join(x), gap]
            at += len(x) + len(gap)
        found = [f for f in license_scan.notices_in("".join(parts)) if f.label == label and f.size == len(notice)]
        assert len(found) == len(places), notice
        assert all(f.edits == e and f.start < b and a < f.end for f, (a, b, e) in zip(found, places, strict=True)), notice


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def places_by_hand(joined, notice, edits, word):
    """(start, end, edits) of all places from word to word within the edits that hold the notice's own word."""
    starts = [i for i in range(len(joined)) if joined[i] != " " and (i == 0 or joined[i - 1] == " ")]
    ends = [i + 1 for i in range(len(joined)) if joined[i] != " " and (i + 1 == len(joined) or joined[i + 1] == " ")]

    def within(a, b, phrase, most):
        return [(i, j, d) for i in starts if a <= i for j in ends if i < j <= b and abs(j - i - len(phrase)) <= most and (d := distance(joined[i:j], phrase)) <= most]

    return [(i, j, d) for i, j, d in within(0, len(joined), notice, edits) if within(i, j, word, len(word) // license_scan.LETTERS)]


def test_places_equal_brute_force():
    """Every place that edit distances give is found, or overlaps one that is at least as good; nothing else is."""
    r = random.Random(6)
    for notice, label, edits, word in license_scan.NOTICES:
        for _ in range(25):
            x = list(notice)
            for _ in range(r.randint(0, edits + 1)):
                k, at = r.randrange(3), r.randrange(len(x))
                x[at : at + (k > 0)] = [r.choice("abcdef ")] if k < 2 else []
            joined = " ".join(" ".join(["qq zz", "".join(x), "vv", r.choice(["the general public license", "mit", "", notice])]).split())
            want = places_by_hand(joined, notice, edits, word)
            got = [(f.start, f.end, f.edits) for f in license_scan.every_notice(joined) if (f.label, f.size) == (label, len(notice))]
            assert set(got) <= set(want), (notice, joined)
            assert all(any(a < j and i < b and e <= d for a, b, e in got) for i, j, d in want), (notice, joined, want, got)


def test_notices_are_told_apart():
    labels = lambda t: sorted({f.label for f in license_scan.notices_in(t)})
    assert labels("gnu lesser general public license") == ["lgpl"] and labels("gnu affero general public license") == ["agpl"]
    assert labels("the general public license") == labels("released under the new license") == []
    assert labels("gnu general publik license") == ["gpl"] and labels("gnu lesser general publik licence") == ["lgpl"]
    for k in (1, 2, 3):
        assert len(license_scan.notices_in(" ".join(["released under the mit license"] * k))) == k


def test_long_texts_of_common_seeds():
    text = "general public " * 40_000 + "gnu general public license " + "all rights reserved " * 5_000
    found = license_scan.notices_in(text.strip())
    assert Counter(f.label for f in found) == {"gpl": 1, "reserved": 5_000}


def test_base_columns_equal_their_sql(spark, docs):
    texts = ["CC BY cc by-nc, the MIT License.", "gnu general public license, Apache-License!", None, "", "É MIT licenses mit  license\n", "cc by mit license apache license cc by"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.selectExpr("doc_id + 1000", "text"))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = license_scan.base(df).toPandas()
    assert plain_rows(got, list(got.columns)) == plain_rows(con.sql(license_scan.BASE_ORACLE).df(), list(got.columns))


# 5 ----------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 90)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist()) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 520)]
    rows += [(600, None), (620, [None] * 6), (640, [float("nan")] * 6), (660, [float("inf")] + [0.0] * 5), (680, []), (700, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, dim int")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, every=20, k=5).collect())
    v = {i: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if i is not None and i < 600}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components_and_repeated_ids(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0**30, 2.0**30]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=9).collect())
    most = 2**63 - 1
    assert got == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 20, most), (0, 4, 20, 4096), (0, 5, 20, 4096), (0, 6, 2, -most)] + [(20, 1, 3, 2**42), (20, 2, 0, 4096), (20, 3, 1, 0), (20, 4, 2, 0)]


def test_bounds_hold():
    r = np.random.default_rng(3)
    q, v = r.integers(-9, 9, (5, 4)).astype(float), r.integers(-9, 9, (50, 4)).astype(float)
    lists = topk.Lists(v)
    for look in range(len(lists.depths)):
        lower, upper = lists.lower(q, look), lists.upper(q, look)
        assert (lower <= q @ v.T).all() and (upper >= q @ v.T).all()
    assert lists.depths[-1] == 50 and (lower == upper).all()
    for look, depth in enumerate(lists.depths[:-1]):
        for i, row in enumerate(q):
            seen = {j for d, x in enumerate(row) if x for j in np.argsort(-x * v[:, d], kind="stable")[:depth]}
            outside = [v[j] @ row for j in range(50) if j not in seen]
            assert max(outside, default=-np.inf) <= lists.unseen(q, look)[i]


@pytest.mark.parametrize("fed", [False, True])
def test_reading_stops_early_and_loses_nobody(fed):
    r = np.random.default_rng(4)
    v, q = np.floor(64 * r.normal(size=(4000, 64))), np.floor(64 * r.normal(size=(20, 64)))
    score = q @ v.T
    best = np.sort(score, axis=1)[:, -20]
    own = np.zeros(score.shape, bool)
    left, depth = topk.read(topk.Lists(v), q, own, best if fed else np.full(20, -np.inf), 20)
    assert (left | (score < best[:, None])).all()
    # Independent dimensions stop early only against a known floor.
    assert (depth <= 4000).all() and (depth >= 1).all()
    if fed:
        assert depth.mean() < 0.8 * 4000 and left.mean() < topk.FEW
    # A block that cannot reach the floor is not read.
    left, depth = topk.read(topk.Lists(v), q, own, np.full(20, 1e9), 20)
    assert not left.any() and not depth.any()
    near = np.where(np.arange(4000)[:, None] < 100, 40.0, 1.0) * np.ones((4000, 64))
    left, depth = topk.read(topk.Lists(near), np.ones((1, 64)), own[:1], np.array([2560.0]), 20)
    assert left.sum() == 100 and depth[0] == 128


@pytest.mark.parametrize("fed", [False, True])
def test_few_entries_of_correlated_lists_are_read(fed):
    """Vectors of few directions: each query reads a small part of its lists, entry by entry, and nobody is lost."""
    r = np.random.default_rng(6)
    n = 6000
    v = np.floor(64 * (r.pareto(2.5, size=(n, 1)) * np.abs(r.normal(size=(1, 32))) + 0.02 * r.normal(size=(n, 32))))
    q = np.floor(64 * np.abs(r.normal(size=(25, 32))))
    q[:, ::7] = 0
    lists, own = topk.Lists(v), np.arange(n)[None, :] == np.arange(25)[:, None]
    score = np.where(own, -np.inf, q @ v.T)
    best = np.sort(score, axis=1)[:, -20]
    read = [topk.opening(lists, row, mine, b if fed else -np.inf, 20) for row, mine, b in zip(q, own, best, strict=True)]
    assert all(left is not None and left.sum() <= topk.FEW * n for left, _ in read)
    left, depth = topk.read(lists, q, own, best if fed else np.full(25, -np.inf), 20)
    assert ((left | (score < best[:, None])).all(axis=1)).all() and depth.tolist() == [d for _, d in read]
    entries = int((depth * np.count_nonzero(q, axis=1)).sum())
    assert entries < 0.05 * n * 32 * 25
    out = topk.best_of_block(np.arange(n), v, np.arange(25), q, 20)
    for i in range(25):
        want = sorted(((-score[i, j], j) for j in range(n) if j != i))[:20]
        assert [(-s, j) for s, j in zip(out[out["query_id"] == i]["score"], out[out["query_id"] == i]["vec_id"], strict=True)] == want


# 6 ----------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = collected(bpe_chunks.digests(docs, path))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[d]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    assert bpe_chunks.digests(nothing, path).count() == 0
    assert collected(bpe_chunks.encoded(docs, path))[8]["ids"] == library.encode(dict(rows)[8] or "", add_special_tokens=False).ids


def test_joins_agree_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_chunks, "LEAST", 8)
    monkeypatch.setattr(bpe_chunks, "MASK", 7)
    path = tokenizer("byte_bpe_50k.json")
    library, e = Tokenizer.from_file(path), bpe_chunks.ChunkEncoder(path)
    r = random.Random(9)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", "  \n\n  x", " \x85 x   y", "x" * 5000, " " * 6000]
    odd += ["".join(r.choice(["the ", " a", "\n", "  ", "don't", "  x'", "s ", ". ", "é", "\t", "日", "\x85", "\xa0", "<|endoftext|>"]) for _ in range(r.randint(1, 300))) for _ in range(300)]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        parts = [p for p in e.parts(text) if p.n]
        assert ",".join(p.ids for p in parts) == ",".join(map(str, ids)), text[:80]
        assert b"".join(p.data for p in parts).decode() == library.decode(ids, skip_special_tokens=False)
    e.parts(odd[-1])
    assert e.reused > 0


# 7 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tiny", [1.0, 1e-12])
def test_forward_sums_all_segmentations(tiny):
    """Short words by recursion over all segmentations, words of any length by exact fractions over prefixes."""
    path = tokenizer("piece_bpe_32k.model")
    numbers = langid.vocabulary(path).pieces
    r = random.Random(10)
    counted = sorted(set(numbers.values()) - set(r.sample(sorted(numbers.values()), 5000)))
    table = {i: [tiny * r.random() / 10, tiny * r.random() / 10] for i in counted}
    floor = [tiny * 0.001, tiny * 0.002]
    scorer = langid.Scorer(path, langid.Model(["a", "b"], np.array(counted), np.array(list(table.values())), np.array(floor)))
    p = lambda x, k: table[numbers[x]][k] if numbers.get(x) in table else floor[k] if x in numbers else langid.UNKNOWN if len(x) == 1 else 0.0

    def mass(text, k):
        return sum(p(text[:end], k) * mass(text[end:], k) for end in range(1, len(text) + 1)) if text else 1.0

    def long_mass(text, k):
        done = [Fraction(1)]
        for end in range(1, len(text) + 1):
            done.append(sum(done[a] * Fraction(p(text[a:end], k)) for a in range(max(0, end - 16), end)))
        return math.log(done[-1].numerator) - math.log(done[-1].denominator)

    words = ["▁the", "▁that", "▁日x", "ing", "▁"]
    assert np.allclose(scorer.forward(words), [[math.log(mass(w, k)) for k in (0, 1)] for w in words])
    words += ["▁" + "".join(r.choice(["the", "tion", "日", "q", "ing"]) for _ in range(n)) for n in (20, 60, 200)]
    assert np.allclose(scorer.forward(words), [[long_mass(w, k) for k in (0, 1)] for w in words])
    scorer.learn({w[1:] for w in words})
    assert np.allclose(scorer.scores[scorer.rows[words[-1][1:]]], scorer.forward(words[-1:])[0])


def test_words_are_runs_of_letters():
    assert langid.words_of("½ ² 5 Ⅷ ① _") == []
    assert langid.words_of("Año2x² İs, d'été ⅷa日本") == ["año", "x", "i", "s", "d", "été", "a日本"]
    assert langid.words_of("x" * 500) == ["x" * 500]


def test_languages_of_held_out_texts(spark, nothing, monkeypatch):
    r = random.Random(11)
    sounds = {"aa": ["the", "ing", "tion", "and", "er"], "bb": ["ung", "sch", "keit", "der", "ein"], "cc": ["eau", "oui", "ment", "les", "que"]}
    rows = [(i, " ".join("".join(r.choice(sounds[k]) for _ in range(r.randint(1, 3))) for _ in range(12)), k, "s", 1, "", "", 1, "") for i, k in enumerate(r.choices(list(sounds), k=300))]
    rows += [(1000, None, "aa", None, None, "", "", 1, ""), (1001, "½ ² 5 Ⅷ!", None, None, None, "", "", 1, ""), (1002, "x" * 500, None, "s", 1, "", "", 1, ""), (None, "the thing", None, "s", 1, "", "", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = tokenizer("piece_bpe_32k.model")
    got = {x["doc_id"]: x for x in langid.identify(df, path).collect()}
    held = [x for x in rows[:300] if got[x[0]]["held_out"]]
    assert held and sum(got[x[0]]["lang_pred"] == x[2] for x in held) >= 0.98 * len(held)
    assert (got[1000]["lang_pred"], got[1000]["score"]) == ("und", 0.0) and got[1001]["lang_pred"] == "und"
    assert got[1002]["lang_pred"] in sounds and got[None]["lang_pred"] == "aa"
    assert langid.identify(nothing, path).count() == 0
    monkeypatch.setattr(langid, "TOGETHER", 2)  # the same by groups of languages
    again = {x["doc_id"]: x for x in langid.identify(df, path).collect()}
    assert all(again[k]["lang_pred"] == x["lang_pred"] and abs(again[k]["score"] - x["score"]) < 1e-9 for k, x in got.items())
    only = df.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in langid.identify(only, path).collect()} == {"und"}


# 8 ----------------------------------------------------------------------------------------------


def places_hold(blocks, size):
    """Every block is taken between release and deadline, and at every slot each source is less than a block from its weight."""
    m, done, number = len(blocks), Counter(), sum(size.values())
    assert m == number and [x["slot"] for x in blocks] == list(range(m))
    for t, x in enumerate(blocks):
        s, b = x["source"], size[x["source"]]
        i = done[s]
        assert (x["release"], x["deadline"]) == (i * m // b, -(-(i + 1) * m // b)) and x["release"] <= t < x["deadline"] and x["block"] == i
        done[s] += 1
        assert all(abs(done[o] * m - (t + 1) * n) < m for o, n in size.items())


@pytest.mark.parametrize(("block_rows", "blocks"), [(1, 10**6), (3, 10**6), (2, 100)])
def test_mix_stays_within_a_block_of_the_weights(spark, nothing, block_rows, blocks):
    """Sources of all sizes, down to one row: at every slot of the whole mix, with all rows in it, as its SQL has it."""
    r = random.Random(12)
    rows = [(i, "t", "en", r.choice(["big"] * 6 + ["b", "c", "d", None]), 1, "", "", 1, "") for i in range(3000)]
    rows += [(None, None, None, "b", None, "", "", 1, ""), (7, "t", "en", "c", 1, "", "", 1, "")] + [(9000 + i, "t", "en", f"tiny{i}", 1, "", "", 1, "") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    df = mixing.mix(docs, keep=("in_text",), block_rows=block_rows, blocks=blocks).toPandas().replace({np.nan: None})
    assert len(df) == len(rows) and df["in_mix"].all()
    rows_in = max(block_rows, -(-len(rows) // blocks))
    assert (df["position"] // rows_in == df["slot"]).all() and df["position"].is_unique
    whole = df.drop_duplicates(["source", "block"]).sort_values("slot").to_dict("records")
    places_hold(whole, {s: -(-n // rows_in) for s, n in Counter(x["source"] for x in df.to_dict("records")).items()})
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source").toPandas().astype({"doc_id": "Int64"}))
    columns = [c for c in df.columns if c != "in_in_text"]
    assert plain_rows(df, columns) == plain_rows(con.sql(mixing.oracle(block_rows, blocks)).df(), columns)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("sizes", [[400, 300, 200, 100, 3], [5] * 200 + [1000], [11] * 300 + [2500], [1], [7, 1], [1000], [999, 1, 1]])
def test_schedules_of_uneven_sources(spark, sizes):
    """Many small sources beside a large one: still less than a block at every slot, wherever folds are cut."""
    size = {f"s{i:03d}": b for i, b in enumerate(sizes)}
    blocks = spark.createDataFrame(list(size.items()), "src string, b long")
    for period in (50, 1000):
        got = mixing.schedule(blocks, period).orderBy("slot").toPandas().rename(columns={"src": "source"})
        places_hold(got.to_dict("records"), size)


def test_blocks_stay_small_in_a_large_mix(spark):
    """More blocks than 65,536: each still has block_rows rows, in the query and in its SQL."""
    docs = spark.range(70_001).selectExpr("id AS doc_id", "if(id % 10 < 7, 'big', concat('s', id % 3)) AS source")
    df = mixing.mix(docs, block_rows=1).toPandas()
    assert sorted(df["position"]) == list(range(70_001)) and (df["position"] == df["slot"]).all()
    places_hold(df.sort_values("slot").to_dict("records"), Counter(df["source"]))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT range AS doc_id, if(range % 10 < 7, 'big', 's' || range % 3) AS source FROM range(70001)")
    sizes = mixing.oracle(1).split("parts AS")[0].rstrip(" ,\n") + " SELECT DISTINCT size FROM taken"
    assert con.sql(sizes).fetchall() == [(1,)]


def test_segments_make_one_schedule(spark):
    """What segments start from is what the slots before them leave: the same picks as slot by slot, wherever segments end."""
    r = random.Random(6)
    for period in (2, 9, 41):
        sizes = [r.choice([1, 1, 2, r.randint(1, 40), r.randint(1, 400)]) for _ in range(r.randint(2, 12))]
        m, done, want = sum(sizes), [0] * len(sizes), []
        for t in range(m):
            _, j = min((-(-(d + 1) * m // b), j) for j, (d, b) in enumerate(zip(done, sizes, strict=True)) if d < b and d * m // b <= t)
            want.append((f"s{j:02d}", done[j]))
            done[j] += 1
        blocks = spark.createDataFrame([(f"s{j:02d}", b) for j, b in enumerate(sizes)], "src string, b long")
        assert [(x["src"], x["block"]) for x in mixing.schedule(blocks, period).orderBy("slot").collect()] == want


@pytest.mark.parametrize("shares", [["a"], ["a", "b"], ["a", "b", "c"], ["a"] * 9 + ["b"], [None]])
def test_few_or_uneven_sources_keep_every_row(spark, shares):
    docs = spark.createDataFrame([(i, f"t{i}", "en", shares[i % len(shares)], 1) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert mixing.mix(docs).where("in_mix").count() == 1000
    staged = corpus_pipeline.mixing_stage(spark, docs, "")
    assert sorted(map(tuple, staged.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_stage_writes_rows_in_the_order_of_the_mix(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "if(id % 3 = 0, 'a', concat('s', id % 11)) AS source", "1L AS n_chars").repartition(4)
    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("position").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()] == want


def test_one_rare_source_keeps_the_mix(spark):
    docs = spark.range(200_001).selectExpr("id AS doc_id", "if(id = 200000, 'rare', concat('s', id % 4)) AS source")
    assert mixing.mix(docs).where("in_mix").count() == 200_001


def test_given_weights(spark):
    rows = [(i, "t", "en", "ab"[i % 2], 1, "", "", 1, "") for i in range(400)] + [(900, "t", "en", "zz", 1, "", "", 1, "")]
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, share long")
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=weights, block_rows=1).collect()
    inside = Counter(x["source"] for x in got if x["in_mix"])
    assert abs(inside["a"] - 3 * inside["b"]) <= 3 and inside["a"] == 200 and len(got) == 401


def test_a_source_of_one_row_ends_no_mix(spark):
    """All rows stay in, whatever the sizes of their sources."""
    source = "CASE WHEN id = 0 THEN 'one' WHEN id = 1 THEN NULL WHEN id < 25 THEN 'few' WHEN id < 12000 THEN 'big' ELSE concat('s', id % 4) END"
    docs = spark.range(24000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", f"{source} AS source", "1L AS n_chars").repartition(4)
    sizes = Counter(r["source"] for r in docs.collect())
    got = mixing.whole_mix(docs).toPandas()
    want = dict(sizes)
    inside = got[got["in_mix"]].sort_values("position")
    assert len(got) == 24000 and Counter(x if isinstance(x, str) else None for x in inside["source"]) == want
    assert inside["position"].tolist() == list(range(len(inside))) and got[~got["in_mix"]]["position"].isna().all()
    for s, n in want.items():
        mine = np.cumsum([(x if isinstance(x, str) else None) == s for x in inside["source"]])
        ideal = np.arange(1, len(inside) + 1) * n / len(inside)
        assert (mine - ideal > -1).all() and (mine - ideal <= 1 + len(want) * n / len(inside)).all()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source").toPandas().replace({np.nan: None}))
    rows = con.sql(mixing.WHOLE_ORACLE).df()[list(got.columns)]
    plain = lambda df: sorted(map(repr, df.astype({"deadline": float, "position": float}).values.tolist()))
    assert plain(got.replace({None: np.nan})) == plain(rows.replace({None: np.nan}))
    assert Counter(r["source"] for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()) == want


# 9 ----------------------------------------------------------------------------------------------


def test_quality_equals_its_sql(spark, docs, rows, nothing):
    got = quality.judge(docs).drop("clean_text").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(quality.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.to_dict("list") == want.to_dict("list")
    assert quality.judge(nothing).count() == 0


def test_long_clean_lines_may_hold_furniture(spark):
    """A phrase or two bars in a long line fail nothing; short lines and lines made of them fail."""
    r = random.Random(9)
    words = lambda k: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(k))
    long = [f"{words(40)} {p} {words(40)}." for p in (*quality.BOILERPLATE, "|x|")]
    bad = ["Home | About | Contact", "Click here to read more.", " | ".join(["Home page", "Our news", "Contact us"] * 5)]
    bad.append(" ".join(["Sign up for news, read more, click here, accept cookies."] * 2))
    docs = spark.createDataFrame(list(enumerate(long + bad)), "doc_id long, text string")
    got = collected(quality.judge(docs))
    assert all(got[i]["kept"] and got[i]["n_bad_lines"] == 0 and got[i]["clean_text"] == t for i, t in enumerate(long))
    assert all(got[len(long) + i]["n_bad_lines"] == 1 for i in range(len(bad)))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = [c for c in quality.judge(docs).columns if c != "clean_text"]
    want = con.sql(quality.ORACLE).df().set_index("doc_id", drop=False)[columns]
    assert all([got[i][c] for c in columns] == want.loc[i].tolist() for i in got)
    staged = {x["doc_id"]: x["text"] for x in corpus_pipeline.quality_stage(spark, docs.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source", "1L AS n_chars"), "").collect()}
    assert all(staged[i] == t for i, t in enumerate(long))


def test_paragraphs_keep_their_borders(spark):
    """Lines without a word stay, also around lines that go."""
    first, last = "A first paragraph of some clean words that ends well.", "And the next one after it, which is as clean as that."
    texts = [f"{first}\n\n{last}", f"\n{first}\n \t\n\nHome | Help\n\n{last}\r\n\n", "A.\n\nB.", "\n\n", ""]
    got = collected(quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["clean_text"] for i in range(5)] == [texts[0], texts[1].replace("Home | Help\n", ""), *texts[2:]]
    assert [got[i]["n_lines"] for i in range(5)] == [2, 3, 2, 0, 0] and [got[i]["kept"] for i in range(5)] == [True, True, False, False, False]


def test_repeated_words_by_hand(docs, rows):
    got = collected(quality.judge(docs))
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert got[d]["n_repeat_words"] == len({i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)})
        assert got[d]["n_words"] == len(w)


def test_line_rules(spark):
    clean = "This is a plain line of clean words that ends well.\nAnd here is another one, just as long as that was."
    nav = "Home | About | Contact | News | Sports | Weather | More\n" * 3
    rows = [(1, clean), (2, nav + "one short line here.\n" + nav), (3, clean + "\nAll rights reserved."), (4, "SHOUTING WORDS ALL OVER THIS LINE!! AND EVEN MORE OF THEM HERE!!")]
    got = collected(quality.judge(frame(spark, rows)))
    assert [got[d]["kept"] for d in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[3]["clean_text"] == clean


def test_lines_are_read_once(spark):
    """A line is lower-cased for all phrases at once, counted in no map of characters and cut into words for no rule."""
    told = quality.judge(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().analyzed().toString()
    rules = str(quality.bad_line(F.col("x")))
    assert rules.count("lower(") == 2 and "split(" not in rules  # for phrases, and for lines without small letters
    assert "translate(" not in told


def test_line_rules_at_their_borders(spark):
    """Lines around every limit, with odd blanks, letters that have no other case, and long lines, equal their SQL."""
    odd = " \t\x0b\f\r"
    r = random.Random(29)
    lines = [r.choice(["", *odd]) + "".join(w + r.choice(odd) * r.randint(1, 3) for w in ["Wort"] * n) + end for n in (1, 3, 4, 5, 8, 9, 10, 11) for end in ("", "end", "end.", "end.)\t", "| |", "|", "read more", "Read More.")]
    lines += ["ÄÖÜ ÉÈ ÑÇ ŁŚ ДЖЮ ΩΣΔ ŽŠ", "ÄÖÜ ÉÈ ÑÇ ŁŚ ДЖЮ ΩΣΔ Žš", "日本語 テキスト 日本語 テキスト 日本語 テ", "1234567890 1234567890 12", "SHORT CAPS OF NINETEEN!"[:19], "SHORT CAPS OF TWENTY!!"[:20], "ALL CAPS WITH ONE SMALL LETTEr"]
    lines += [f"{'x' * k}{s * 2} and so on it goes for some words." for s in quality.SYMBOLS for k in (1, 2)] + ["#" * k + "a" * 18 for k in (1, 2, 3)]
    lines += ["x" * 300_000, " " * 300_000 + "x", "x" + " " * 300_000 + "y", "|" * 100_000]
    again = "one two three four five six"
    texts = [*lines, "\n".join(lines[:64]), f"{again} {again}", f"{again}\n{again} seven {again}", "a " * 4, "a " * 5, "a " * 6, "a b " * 5, "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.judge(docs).drop("clean_text").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(quality.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.to_dict("list") == want.to_dict("list")


# 10 ---------------------------------------------------------------------------------------------


def groups_by_hand(rows, ngram, percent=80):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)], least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.mark.parametrize("ngram", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, rows, ngram):
    got = {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in collected(minhash.near_duplicates(docs, ngram)).items()}
    assert got == groups_by_hand(rows, ngram)


def test_estimates_change_no_result(docs):
    cut, full = (sorted(map(tuple, minhash.near_duplicates(docs, 2, least_estimate=e).collect()), key=repr) for e in (minhash.LEAST_ESTIMATE, -9.0))
    assert cut == full


def test_links_that_no_hub_has(spark, monkeypatch):
    """Chains of edits, dealt over small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    r = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    rows, ws = [], [r.choice(words) for _ in range(80)]
    for i in range(70):
        if r.random() < 0.3:
            ws = [r.choice(words) for _ in range(80)] if r.random() < 0.1 else ws
        copy = list(ws)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(80)] = r.choice(words)
        if r.random() < 0.5:
            ws = copy
        rows.append((i, " ".join(copy)))
    got = {d: (x["n_shingles"], x["component_id"], x["kept"]) for d, x in collected(minhash.near_duplicates(frame(spark, rows), 2)).items()}
    assert got == groups_by_hand(rows, 2)


def test_near_duplicates_with_null_ids_and_repeated_rows(spark, nothing):
    text = " ".join(f"w{i}" for i in range(50))
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(frame(spark, [(5, text), (5, text), (None, text), (3, text + " more"), (None, None), (9, "")])).collect())
    assert got == [("3", "3", True), ("5", "3", False), ("5", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", True)]
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.one_of_each(nothing).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat an id, alike or in other groups, with columns whose names the operator uses itself."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(6, c), (2, c), (6, c + " " + b[:60] + " " + a[:60]), (5, a), (5, a), (5, a + " more"), (9, a), (5, b), (7, b), (None, "x y"), (None, "x y"), (3, ""), (3, ""), (4, "alone here")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in minhash.one_of_each(frame(spark, rows)).collect())
    assert got == sorted([("2", c), ("6", c + " " + b[:60] + " " + a[:60]), ("5", a), ("5", b), ("None", "x y"), ("3", ""), ("3", ""), ("4", "alone here")])


def test_estimate_is_near_the_similarity(spark):
    r = np.random.default_rng(14)
    a = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))])
    sig = minhash.packed(minhash.minima([a, b])).tolist()
    got = spark.createDataFrame([tuple(sig)], "x array<long>, y array<long>").select(minhash.estimate("x", "y").alias("e"), minhash.estimate("x", "x").alias("one")).first()
    assert abs(got["e"] - 800 / 1200) < 0.2 and got["one"] == 1.0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100}


def test_windows_that_go_are_those_whose_factor_reaches_the_length():
    """The neighbours in suffix order say what previous and next smaller positions say."""
    r = random.Random(15)
    text = bytes(r.choices(b"ab", k=400)) * 2 + bytes(r.choices(b"abc", k=300))
    n, length = len(text), 20
    order = sorted(range(n), key=lambda i: text[i:])

    def share(a, b):
        k = 0
        while a + k < n and b + k < n and text[a + k] == text[b + k]:
            k += 1
        return k

    common = [0] + [share(a, b) for a, b in zip(order, order[1:], strict=False)]
    factor = suffix_dedup.previous_factor(np.array(order), np.array(common), np.arange(n))
    rows, offsets = suffix_dedup.later_windows([(0, 0, 0, text)], length)
    assert sorted(offsets.tolist()) == [i for i in range(n) if factor[i] >= length]


def test_factors_on_the_main_path_are_longest_previous_ones():
    """Factors of all windows of several rows take many values, are decided past larger neighbours, and equal those of all pairs."""
    r = random.Random(22)
    base = bytes(r.choices(b"abcdef", k=300))
    texts = [base[:170], base[20:200] + b"zz" + base[:60], b"ab" * 90, b"ab" * 70 + b"c", base[90:260], bytes(r.choices(b"xy", k=150)), base[:170]]
    # Rows in no order; the second of document 3 overlaps its first.
    rows = [(5, 1, 0, texts[0]), (2, 1, 0, texts[1]), (3, 1, 0, texts[2]), (3, 1, 40, texts[2][40:]), (9, 1, 7, texts[3]), (1, 1, 0, texts[4]), (4, 1, 0, texts[5]), (5, 2, 0, texts[6])]
    length = 12
    who, offset, factor = suffix_dedup.factors_of(rows, length)
    places = [(*rows[w][:2], rows[w][2] + o) for w, o in zip(who.tolist(), offset.tolist(), strict=True)]
    parts = [rows[w][3][o:] for w, o in zip(who.tolist(), offset.tolist(), strict=True)]

    def share(a, b):
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    want = [max((s for p, part in zip(places, parts, strict=True) if p < place and (s := share(own, part)) >= length), default=0) for place, own in zip(places, parts, strict=True)]
    assert factor.tolist() == want and len(set(want)) > 60
    order = sorted(range(len(parts)), key=lambda i: (parts[i], places[i]))
    passed = sum(want[i] > 0 and places[a] > places[i] and places[b] > places[i] for a, i, b in zip(order, order[1:], order[2:], strict=False))
    assert passed > 5


def test_suffix_order_of_periodic_text_ends(monkeypatch):
    data = np.frombuffer(b"a" * 3000 + b"ab" * 900 + b"a" * 10, np.uint8)
    ends = np.repeat([3000, 4800, 4810], [3000, 1800, 10])
    a, b = np.array([0, 3000, 0, 10]), np.array([5, 3002, 4800, 11])
    for most, want in ((1024, [1024, 1024, 10, 1024]), (10_000, [2995, 1798, 10, 2989])):
        monkeypatch.setattr(suffix_dedup, "TOLD", most)
        levels = suffix_dedup.suffix_ranks(data, ends)
        assert suffix_dedup.common_bytes(data, ends, levels, a, b).tolist() == want
        assert [w for w, _ in levels] == [4 << k for k in range(len(levels))] and levels[-1][0] >= min(most, 3000)


def test_suffix_ranks_order_all_suffixes():
    r = random.Random(31)
    for n, letters in ((400, b"ab"), (300, b"abc"), (50, b"a"), (1, b"x")):
        data, cut = bytes(r.choices(letters, k=n)), sorted({n, *(r.randint(1, n) for _ in range(6))})
        ends = np.repeat(cut, np.diff([0, *cut]))
        for width, rank in suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), ends):
            head = [data[i : min(i + width, ends[i])] for i in range(n)]
            assert sorted(range(n), key=lambda i: (rank[i], i)) == sorted(range(n), key=lambda i: (head[i], i))  # noqa: B023
            assert all((rank[i] == rank[j]) == (head[i] == head[j]) for i in range(0, n, 7) for j in range(n))


def test_scores_of_many_languages_stay_in_bounds(monkeypatch):
    """256 languages and 60,000 different words, in texts of any length: what is remembered is bounded by numbers, and sums are those of few words at a time."""
    path = tokenizer("piece_bpe_32k.model")
    r = np.random.default_rng(3)
    counted = np.sort(r.choice(np.array(sorted(langid.vocabulary(path).pieces.values())), 500, replace=False))
    p = r.dirichlet(np.ones(501), 256).T
    model = langid.Model([f"l{k:03d}" for k in range(256)], counted, p[:500], p[500])
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(60_000)]
    texts = [words[:40_000], [], words[40_000:40_100], *([w] for w in words[40_100:41_000]), words[41_000:]]
    scorer = langid.Scorer(path, model)
    tracemalloc.start()
    got = dict(scorer.totals(texts))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 500e6 and scorer.scores.size <= langid.SCORES
    assert sorted(got) == [k for k, t in enumerate(texts) if t]
    for k in (2, 3, 500):
        assert np.allclose(got[k], langid.Scorer(path, model).sums([texts[k]])[0])
