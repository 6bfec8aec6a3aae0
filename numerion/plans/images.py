"""Queries that draw a page for each supplier and read it: whole runs over pixels. SQL can't say these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerion.operators import detection as D
from numerion.operators import models as M
from numerion.operators import reading as R
from numerion.operators import samples
from numerion.params import Sheet
from numerion.sources import tables as S


#: Pages that a task draws: more suppliers are more tasks, not larger ones.
TASK_PAGES = 250


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page of each supplier says: its key, and its nation and cents, in two lines."""
    rows = S.table(spark, sf_dir, "supplier")
    cents = F.floor(F.abs("s_acctbal") * 100).cast("long").cast("string")
    lines = F.array(F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.concat(F.col("s_nationkey").cast("string"), cents))
    return rows.select(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("image_id"), lines.alias("lines"), samples.category_of(F.col("s_suppkey")).alias("category"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier."""
    rows = _lines(spark, sf_dir)
    return samples.pages(rows.repartition(max(16, -(-rows.count() // TASK_PAGES))))


def detected_pages(spark, sf_dir):
    """image_id, text, digit_count, n_rejected and the digits as JSON."""
    got = D.detect(_pages(spark, sf_dir), M.Templates())
    return got.select("image_id", "status", "text", "digit_count", F.size("rejected").alias("n_rejected"), F.to_json("digits").alias("digits"), F.round("ref_height", 1).alias("ref_height"))


def detection_accuracy(spark, sf_dir):
    """Per category of page: exact texts and right digits."""
    got = D.detect(_pages(spark, sf_dir), M.Templates()).select("image_id", "text")
    pairs = _lines(spark, sf_dir).select("image_id", "category", F.array_join("lines", "\n").alias("truth")).join(got, "image_id")
    return R.sequence_accuracy(pairs.select("category", "truth", F.col("text").alias("read")))


def digit_crops(spark, sf_dir):
    """One row per digit: its place in reading order, and sum and size of its normal form."""
    crops = D.crops(D.segment(_pages(spark, sf_dir)))
    return crops.select("image_id", "pos", "line", F.size("tensor").alias("size"), F.round(F.aggregate("tensor", F.lit(0.0), lambda a, v: a + v), 3).alias("mass"))


def sheet_search(spark, sf_dir):
    """Whether a page is a sheet that fills its frame, or lies on one."""
    got = D.segment(_pages(spark, sf_dir), sheet=Sheet())
    return got.select("image_id", "found", F.col("sheet.fills").alias("fills"), F.round("sheet.area", 4).alias("area"))


QUERIES = {
    "detected_pages": (detected_pages, None),
    "detection_accuracy": (detection_accuracy, None),
    "digit_crops": (digit_crops, None),
    "sheet_search": (sheet_search, None),
}
