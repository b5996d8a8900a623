"""Joins of names by their bigrams: which lie in one another, which are close.

Bigrams are ordered by how many names have them, rarest first, and names meet on rare
ones only. A name that lies in another has all its bigrams there, so its rarest one is
enough. Of two close names at most a known number of each one's bigrams is not in the
other, so the rarest bigram that they share is among the first few of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.operators.rules import checkpointed


def bigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2))))


def _ordered(names: DataFrame, counts: DataFrame) -> DataFrame:
    """s, grams: the bigrams of each distinct string of two characters or more, rarest first."""
    rows = names.select("s").distinct().where(F.length("s") >= 2).select("s", F.explode(bigrams(F.col("s"))).alias("g")).join(counts, "g")
    return rows.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("x")).select("s", F.col("x.g").alias("grams"))


def ordered_bigrams(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For two tables of strings ``s`` the distinct ones with their bigrams in one common order."""
    both = left.select("s").union(right.select("s")).where(F.length("s") >= 2).distinct()
    counts = checkpointed(both.select(F.explode(bigrams(F.col("s"))).alias("g")).groupBy("g").agg(F.count("*").alias("n")))
    return checkpointed(_ordered(left, counts)), checkpointed(_ordered(right, counts))


def _met(a: DataFrame, first: Column, b: DataFrame, second: Column) -> DataFrame:
    left = a.select(F.col("s").alias("a"), F.explode(first).alias("g"))
    right = b.select(F.col("s").alias("b"), F.explode(second).alias("g"))
    return left.join(right, "g").select("a", "b")


def inside(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b of two tables of ``ordered_bigrams``: pairs of which a lies in b."""
    return _met(a, F.slice("grams", 1, 1), b, F.col("grams")).where(F.col("b").contains(F.col("a")))


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b of two tables of ``ordered_bigrams``: pairs of which one lies in the other."""
    outer = inside(b.select("s", "grams"), a).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return inside(a, b).union(outer).distinct()


def close(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a, b, ratio of two tables of ``ordered_bigrams``: pairs with a matching ratio of ``least`` or more.

    With M matched characters in blocks, u of one name and v of the other are left over,
    and there are at most u + v + 1 blocks; a name of n characters then misses at most
    2 u + v of the other's bigrams, which is at most 4 n (1 - least) / (2 - least).
    """
    missing = 4 * (1 - least) / (2 - least)
    first = F.slice("grams", F.lit(1), (F.floor(F.length("s") * F.lit(missing) + 1e-9) + 1).cast("int"))
    short, both = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
    pairs = _met(a, first, b, first).where(2 * short >= least * both).distinct()

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [SequenceMatcher(None, x, y).ratio() for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["a", "b", "ratio"])

    assert 0 < least <= 1 and not math.isnan(least)
    return pairs.mapInArrow(ratios, T.StructType([*pairs.schema.fields, T.StructField("ratio", T.DoubleType())])).where(F.col("ratio") >= least)
