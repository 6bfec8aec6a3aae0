"""Tables that a job writes for itself, where driver and executors both reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; on one machine without a name, one is made. A cluster must name its own."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="numerion-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lost executor repeats nothing that came before."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
