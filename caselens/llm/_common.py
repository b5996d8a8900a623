"""Helpers that the corpus operators share: scratch tables, row splitting, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality, SimHash and mixing contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, one machine) is a folder of
    our own made, once for each application.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="caselens-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None, rows: int | None = None, part: int = 50_000) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back.

    Cuts the lineage, so that a lost executor costs a re-read, not a recomputation.
    With ``rows``, the most that ``df`` can have, it is made by a task for each ``part`` of
    them (one for each core at least), as a small table in a loop would else be a file
    for each shuffle partition in each round.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // part)))
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *names: str) -> DataFrame:
    """All columns of ``df`` inside the struct ``doc``, with the columns ``names``
    beside it, so that no column of the input can clash with one of ours."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), *names)
