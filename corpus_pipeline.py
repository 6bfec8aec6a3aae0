"""A corpus pipeline in stages, each written as Parquet and read again by the next.

Quality rules reject documents and take out failing lines; one document of
each near-duplicate group stays; later copies of repeated passages are cut out; the sources' rows are
put in an order that holds their weights at every point; what is left is encoded in that order.

Each stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables and further columns:
a null or empty text fails the quality rules; of rows that near-dedup groups together one stays, rows without words all do;
cutting and mixing keep every row; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerion.llm import bpe_chunks, minhash, mixing, quality, suffix_dedup
from numerion.llm.common import documents, in_file_order, shared_table, tokenizer

#: The columns that every stage but the last hands on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with another text."""
    return df.select("doc_id", F.col(text).alias("text"), *(F.col(f"in_{c}").alias(c) for c in REST), F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    # Written before the filter: Spark would move a filter below the projection and work the verdict out twice.
    judged = quality.judge(docs, keep=REST).select("doc_id", *(f"in_{c}" for c in REST), "kept", F.expr("if(kept, clean_text, null)").alias("clean_text"))
    return _with_text(shared_table(judged, "judged").where("kept"), "clean_text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return minhash.one_of_each(docs).select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated strings of 100 bytes or more; no document goes."""
    return _with_text(suffix_dedup.cleaned(docs, keep=REST), "clean_text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mix: files and the rows in them follow each other by position."""
    mixed = mixing.in_order(mixing.mix(docs, keep=("text", "lang", "n_chars")))
    return mixed.select("doc_id", F.col("in_text").alias("text"), F.col("in_lang").alias("lang"), "source", F.col("in_n_chars").alias("n_chars"))


def encoded_in_order(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and position of every document, in the order of the mix: that of the files of ``docs`` and the rows in them."""
    return bpe_chunks.encoded(in_file_order(docs), tokenizer("byte_bpe_50k.json"), keep=("position",))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document; files and the rows in them follow each other as those of ``docs`` do."""
    return encoded_in_order(docs).drop("position")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; with the tokens, each row's position in the mix."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return encoded_in_order(docs)


#: Near-duplicate groups and encodings can't be said in SQL.
ORACLE_SQL = None
