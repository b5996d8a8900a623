"""The incidence of nodes and hyperedges as a sparse matrix of blocks.

Rows are nodes and columns edges, numbered densely in order of their ids: ranges of ids
are numbered apart and moved by the sizes of the ranges before. A block holds SIDE rows
and SIDE columns as compressed rows, so a node or an edge of any degree is spread over
many blocks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators.rules import PART_ROWS, checkpointed, dealt

SIDE = 4096


class Incidence(NamedTuple):
    """rows: node_id, row; columns: edge_id, col; blocks: brow, bcol, rows (array of row and
    cols, both within the block)."""

    rows: DataFrame
    columns: DataFrame
    blocks: DataFrame


def numbered(ids: DataFrame, key: str, name: str, rows: int | None = None) -> DataFrame:
    """``key`` and ``name``, its place (from 0) among the distinct non-null keys in order. ``rows``: at
    most so many keys, counted if not given."""
    n = max(-(-(ids.count() if rows is None else rows) // PART_ROWS), int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ids.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    # written before the ranges are counted, as another run may draw them elsewhere
    place = F.monotonically_increasing_id()
    keys = checkpointed(keys.select(key, F.shiftright(place, 33).alias("__range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    sizes = keys.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("__range").alias("__r"), (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # a row for each range
    return keys.join(F.broadcast(before), F.col("__range") == F.col("__r")).select(key, (F.col("__before") + F.col("__at")).alias(name))


def build(participants: DataFrame, nodes: DataFrame, side: int = SIDE) -> Incidence:
    """The matrix of ``participants`` (edge_id, node_id): memberships once each, whatever the
    role, and only those of ``nodes`` (node_id)."""
    n = participants.count()
    members = dealt(participants.select("edge_id", "node_id").where("edge_id IS NOT NULL"), "edge_id", rows=n).distinct()
    rows, columns = checkpointed(numbered(nodes, "node_id", "row")), checkpointed(numbered(members, "edge_id", "col", n))
    at = dealt(members.join(columns, "edge_id").select("node_id", "col"), "node_id", rows=n).join(rows, "node_id").select("row", "col")
    part = lambda c: F.floor(F.col(c) / side).cast("long")
    inner = lambda c: (F.col(c) % side).cast("int")
    at = dealt(at.select(part("row").alias("brow"), part("col").alias("bcol"), inner("row").alias("row"), inner("col").alias("col")), "brow", "bcol", rows=n)
    lines = at.groupBy("brow", "bcol", "row").agg(F.sort_array(F.collect_list("col")).alias("cols"))
    return Incidence(rows, columns, checkpointed(lines.groupBy("brow", "bcol").agg(F.sort_array(F.collect_list(F.struct("row", "cols"))).alias("rows"))))


def entries(matrix: Incidence, side: int = SIDE, rows: int | None = None) -> DataFrame:
    """edge_id, node_id of every cell that is set. ``rows``: at most so many, counted if not given."""
    if rows is None:
        rows = matrix.blocks.agg(F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda n, x: n + F.size(x["cols"])))).first()[0] or 0
    lines = matrix.blocks.select("brow", "bcol", F.explode("rows").alias("x")).select("brow", "bcol", "x.row", F.explode("x.cols").alias("col"))
    at = lines.select((F.col("brow") * side + F.col("row")).alias("row"), (F.col("bcol") * side + F.col("col")).alias("col"))
    named = dealt(at, "row", rows=rows).join(matrix.rows, "row").select("col", "node_id")
    return dealt(named, "col", rows=rows).join(matrix.columns, "col").select("edge_id", "node_id")


def verify(matrix: Incidence, participants: DataFrame, side: int = SIDE) -> DataFrame:
    """edge_id, listed, held, missing, surplus of each edge: its members by the list, those in
    its column, and how many are in one only. A column agrees if the last two are 0."""
    n = participants.count()
    listed = participants.select("edge_id", "node_id").where("edge_id IS NOT NULL").withColumn("l", F.lit(1))
    held = entries(matrix, side, n).withColumn("h", F.lit(1))
    # a union, as null members are equal in a grouping; a member of several roles is listed once
    both = listed.select("edge_id", "node_id", "l", F.lit(0).alias("h")).union(held.select("edge_id", "node_id", F.lit(0), "h"))
    pairs = dealt(both, "edge_id", rows=2 * n).groupBy("edge_id", "node_id").agg(F.max("l").alias("l"), F.sum("h").alias("h"))
    return pairs.groupBy("edge_id").agg(
        F.count_if(F.col("l") > 0).alias("listed"), F.sum("h").alias("held"), F.count_if(F.col("h") == 0).alias("missing"), F.sum(F.greatest(F.col("h") - F.col("l"), F.lit(0))).alias("surplus")
    )
