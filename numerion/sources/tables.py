"""Views that let tables without images stand for the pipeline's stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The page that the boxes lie on.
PAGE_WIDTH, PAGE_HEIGHT = 400, 240
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, comp_id, x, y, w, h, ink: one order is one page, one line item one component."""
    # Named before it is a key: rows dealt by it are then known to be dealt by image.
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    place = Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    wide = (F.col("l_partkey") + F.col("l_linenumber")) % 50 == 0
    found = lines.select(
        "image_id",
        F.row_number().over(place).cast("long").alias("comp_id"),
        (F.col("l_partkey") * 7 % 300).alias("x"),
        (F.col("l_suppkey") * 11 % 160).alias("y"),
        F.when(wide, 370).otherwise(3 + (F.col("l_partkey") * 5 + F.col("l_linenumber")) % 90).cast("long").alias("w"),
        (3 + (F.col("l_partkey") * 13 + F.col("l_suppkey") * 17) % 70).alias("h"),
    )
    return found.withColumn("ink", 1 + (F.col("x") * 31 + F.col("y") * 17) % (F.col("w") * F.col("h")))


BOXES = """
boxes AS (SELECT image_id, comp_id, x, y, w, h, 1 + (x * 31 + y * 17) % (w * h) AS ink FROM (
  SELECT l_orderkey AS image_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS comp_id,
    (l_partkey * 7) % 300 AS x, (l_suppkey * 11) % 160 AS y,
    CAST(CASE WHEN (l_partkey + l_linenumber) % 50 = 0 THEN 370 ELSE 3 + (l_partkey * 5 + l_linenumber) % 90 END AS BIGINT) AS w,
    3 + (l_partkey * 13 + l_suppkey * 17) % 70 AS h FROM lineitem) q)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, t: each embedding as an 8 x 8 gray tile, row by row."""
    gray = F.transform("embedding", lambda v: F.floor(F.lit(128.0) + F.lit(127.0) * v.cast("double")).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), gray.alias("t"))


TILES = """
tiles AS (SELECT vec_id, CAST(label AS BIGINT) AS label,
  list_transform(embedding, lambda v: CAST(floor(128.0::DOUBLE + 127.0::DOUBLE * CAST(v AS DOUBLE)) AS BIGINT)) AS t FROM embeddings)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, p: ten scores of each embedding in whole thousandths that sum to about 1000."""
    v = F.transform(F.slice("embedding", 1, 10), lambda x: F.floor(F.lit(1000.0) * (x.cast("double") + F.lit(1.0)) * (x.cast("double") + F.lit(1.0))).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), v.alias("p"))


PROBS = """
probs AS (SELECT vec_id, CAST(label AS BIGINT) AS label,
  list_transform(embedding[1:10], lambda x: CAST(floor(1000.0::DOUBLE * (CAST(x AS DOUBLE) + 1.0::DOUBLE) * (CAST(x AS DOUBLE) + 1.0::DOUBLE)) AS BIGINT)) AS p
  FROM embeddings)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera, k, event_id, ts, reading: the readings of each camera in order of arrival."""
    events = table(spark, sf_dir, "events")
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("camera"), F.row_number().over(place).cast("long").alias("k"), "event_id", "ts", F.col("event_type").alias("reading"), "value")


FRAMES = """
frames AS (SELECT user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id, ts, event_type AS reading, value FROM events)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, body: pages and documents as request bodies."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("body"))
    return pages.unionByName(docs)


UPLOADS = """
uploads AS (SELECT page_id AS id, 'page' || CAST(page_id AS VARCHAR) || '.html' AS name, html AS body FROM pages
  UNION ALL SELECT doc_id, 'doc' || CAST(doc_id AS VARCHAR), text FROM documents)"""
