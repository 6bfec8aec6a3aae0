"""The pipeline on the smallest tables and on nothing."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from numerion.llm import mixing, quality
from numerion.llm.common import shared_table, tokenizer
from tests.llm.test_operators import SCHEMA, awkward_texts, frame, groups_by_hand, removed_by_hand


def test_stages_hand_on_documents(spark):
    docs = frame(spark, awkward_texts(21, 80)).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared_table(stage(spark, docs, ""), name)
        if name != "encoding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.count() <= before.count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, _, kept) in groups_by_hand(rows, 5).items() if kept}
    assert docs.columns == ["doc_id", "n_tokens", "ids"]
    assert docs.count() > 5


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)


def rows_with_repeats():
    """Awkward texts, some rows twice as they are, some ids twice with other texts, all in ASCII so that bytes are characters."""
    rows = [(d, None if t is None else t.encode("ascii", "ignore").decode()) for d, t in awkward_texts(33, 90)]
    return rows + rows[10:14] + [(12, "Another text with the id of a row that is there, and some more words to be long enough.")]


def test_each_stage_equals_a_plain_version(spark):
    """Every stage over all rows that its predecessor kept, repeated ones with them."""
    docs = frame(spark, rows_with_repeats()).select(*corpus_pipeline.COLUMNS)
    con = duckdb.connect()
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(rows, key=repr)

    # The SQL takes ids to name rows, so rows are numbered for it.
    given = docs.collect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(given)), "text": [r["text"] for r in given]}))
    judged = con.sql(quality.ORACLE).df()
    stays = judged[judged["kept"]]
    cleaned = shared_table(stages["quality_rules"](spark, docs, ""), "quality_test").collect()
    assert sorted(str(r["doc_id"]) for r in cleaned) == sorted(str(given[i]["doc_id"]) for i in stays["doc_id"])
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned) and len(cleaned) > 40
    whole = [given[i]["text"] for i in stays["doc_id"][stays["n_bad_lines"] == 0]]
    assert not Counter(whole) - Counter(r["text"] for r in cleaned)

    docs = spark.createDataFrame(cleaned, docs.schema)
    one = shared_table(stages["near_dedup"](spark, docs, ""), "near_test").collect()
    assert {r["doc_id"] for r in one} <= {r["doc_id"] for r in cleaned} and len({(r["doc_id"], r["text"]) for r in one}) == len(one)
    groups = groups_by_hand([(i, r["text"]) for i, r in enumerate(cleaned)], 5)
    group_of = {}
    for i, r in enumerate(cleaned):
        group_of.setdefault((r["doc_id"], r["text"]), groups[i][1])
    assert sorted(group_of[r["doc_id"], r["text"]] for r in one) == sorted({c for _, c, _ in groups.values()})

    docs = spark.createDataFrame(one, docs.schema)
    want = removed_by_hand([(r["doc_id"], r["text"]) for r in one])
    cut = shared_table(stages["suffix_dedup"](spark, docs, ""), "suffix_test").collect()
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut} == {d: w[3] for d, w in want.items()}

    docs = spark.createDataFrame(cut, docs.schema)
    con.register("documents", docs.select("doc_id", "source").toPandas())
    order = con.sql(f"SELECT doc_id FROM ({mixing.ORACLE}) m ORDER BY position").fetchall()
    mixed = shared_table(stages["mixing"](spark, docs, ""), "mixing_test")
    assert [r["doc_id"] for r in stages["mixing"](spark, docs, "").collect()] == [d for (d,) in order]
    assert key(map(tuple, mixed.collect())) == key(map(tuple, cut))

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_tokens"], list(r["ids"])) for r in stages["encoding"](spark, mixed, "").collect()}
    assert got == {r["doc_id"]: (len(ids := library.encode(r["text"], add_special_tokens=False).ids), ids) for r in cut}


def test_tokens_follow_the_mix(spark):
    """The order that mixing gives is that of the encoded rows, in files and by position, whatever the sizes of the mix's files."""
    rows = [(i, "word " * (i % 7) ** 4, "en", "abc"[i * i % 3] + str(i % 4), 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mix = corpus_pipeline.mixing_stage(spark, docs, "").repartitionByRange(7, "n_chars", "doc_id").sortWithinPartitions("n_chars", F.desc("doc_id"))
        for mixed in (corpus_pipeline.mixing_stage(spark, docs, ""), mix):
            written = shared_table(mixed, "mixed_test")
            want = [r["doc_id"] for r in mixed.collect()]
            assert len(written.inputFiles()) > 2
            coded = shared_table(corpus_pipeline.encoding_stage(spark, written, ""), "coded_test")
            files = sorted(f.removeprefix("file://") for f in coded.inputFiles())
            assert [d for f in files for d in pq.read_table(f)["doc_id"].to_pylist()] == want
            placed = corpus_pipeline.encoded_in_order(written).collect()
            assert [(r["doc_id"], r["position"]) for r in placed] == list(zip(want, range(900), strict=True))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
