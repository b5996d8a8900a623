"""Sharding by a hierarchical weighted hash tree.

A key goes down region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's name, and the
least draw wins, so a child gets keys in proportion to its weight. If weights
change, only draws of nodes on changed paths change: keys move into subtrees that
grew and out of subtrees that shrank, and nowhere else. ``grown`` adds a shard in
a region of its own, so all keys that move go to that shard.

Edge cases: all null keys are one key; a null text has size 1 and an empty text's
checksum; equal keys share their shard; an empty table gives an empty result;
a node of weight 0 never wins; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, racks: int = 4, regions: int = 2) -> list[Shard]:
    """``shards`` equal shards in ``racks`` racks of ``regions`` regions."""
    return [Shard(f"r{k * regions // shards}", f"k{k * racks // shards}", k) for k in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    new = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"r+{new}", f"k+{new}", new, weight)]


def _levels(tree: list[Shard]) -> tuple[list[tuple[str, float, int, int]], list[int]]:
    """Nodes as (name, weight, first child, last child), children of a node
    together, the root first; the shard number of each node (-1 inside)."""
    root: dict = {}
    for s in tree:
        root.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else x
    nodes: list[tuple[str, float, int, int]] = [("", 0.0, 0, -1)]
    shards, queue = [-1], [(0, "", root)]
    for at, name, children in queue:
        first = len(nodes)
        for child, below in children.items():
            nodes.append((f"{name}/{child}", float(weigh(below)), 0, -1))
            shards.append(child if not isinstance(below, dict) else -1)
            if isinstance(below, dict):
                queue.append((len(nodes) - 1, nodes[-1][0], below))
        nodes[at] = (nodes[at][0], nodes[at][1], first, len(nodes) - 1)
    return nodes, shards


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of ``key``: three levels of draws, each over the children of one node."""
    nodes, shards = _levels(tree)
    as_array = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))
    names, weights = as_array([n[0] for n in nodes], "string"), as_array([n[1] for n in nodes], "double")
    firsts, lasts = as_array([n[2] for n in nodes], "int"), as_array([n[3] for n in nodes], "int")

    def draw(k: Column) -> Column:
        # 53 bits of the hash, never 0
        u = (F.shiftrightunsigned(F.xxhash64(key, F.get(names, k)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / F.get(weights, k)).alias("draw"), k.alias("node"))

    node: Column = F.lit(0)
    for _ in range(3):
        node = F.array_min(F.transform(F.sequence(F.get(firsts, node), F.get(lasts, node)), draw))["node"]
    return F.get(as_array(shards, "int"), node)


def assign(documents: DataFrame, tree: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard for each row."""
    text = F.col("text").cast("string")
    light = documents.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    key = F.col("doc_id")
    return light.withColumn("shard", shard_of(key, tree)).withColumn("grown_shard", shard_of(key, grown(tree)))


def with_slots(assigned: DataFrame) -> DataFrame:
    """``slot``: gapless from 0 in each shard, in the order of doc_id.

    Rows are sorted in range partitions of any number; a row's place is its place
    in its partition plus the sizes of the parts before it, so that no shard has
    to fit one task.
    """
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    n = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = assigned.repartitionByRange(n, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = staged(rows.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1))), "slots")
    heads = rows.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("part")) - F.col("held")
    heads = heads.select(F.col("shard").alias("__shard"), F.col("part").alias("__part"), (before - F.col("first")).alias("shift"))
    on = (F.col("shard") == F.col("__shard")) & (F.col("part") == F.col("__part"))
    return rows.join(heads, on).withColumn("slot", F.col("place") + F.col("shift"))


def write_shards(documents: DataFrame, tree: list[Shard], path: str) -> None:
    """The documents themselves, in a folder for each shard."""
    documents.withColumn("shard", shard_of(F.col("doc_id"), tree)).write.partitionBy("shard").parquet(path)
