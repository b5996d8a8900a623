"""The given tables as tables of the case domain."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over the cores if it lies in fewer parts than there are: for work
    inside rows on a small table. One of more parts is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, role, node_id: an order is a hyperedge, its parts are the members."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_returnflag").alias("role"), F.col("l_partkey").alias("node_id"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the executors share: below spark.checkpoint.dir, or our own where it is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="caselens-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
