"""What the training-text operators share: inputs, shared tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where the session names none, one is made on a single machine (tests); a cluster must name its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="numerion-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor
    costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame) -> DataFrame:
    """The rows of written files, one file after the other as their writer numbered them, with their ``position`` from 0.

    Spark reads the largest files first, whatever their numbers. Rows that come from no files stay as they are, with rising positions.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_name").alias("of_file"), F.col("_metadata.row_index").alias("of_row"))
    except AnalysisException:
        return df.withColumn("position", F.monotonically_increasing_id())
    by = Window.orderBy(F.expr("try_cast(regexp_extract(of_file, 'part-([0-9]+)', 1) AS long)"), "of_file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("of_file").agg(F.count("*").alias("n")).select("of_file", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    numbered = placed.join(F.broadcast(files), "of_file").withColumn("position", F.col("before") + F.col("of_row"))
    return numbered.select(*df.columns, "position").repartitionByRange("position").sortWithinPartitions("position")


def text_or_empty(column: str = "text"):
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield [column.to_pylist() for column in batch.columns]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """An Arrow batch of Python lists or arrays in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
