"""Keyword-seeded search in a graph for whole tables of questions.

nodes: id, label, name, description, tags_text; edges: src, dst, type, id (distinct);
questions: question, keyword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import text as X
from caselens.operators import hypergraph, similarity
from caselens.operators.rules import checkpointed


def seeds(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """question, seed: the nodes whose name, description or tags contain a keyword of the
    question (of two characters or more; keywords are normalised, the texts lower-cased)."""
    asked = questions.select("question", X.norm(F.col("keyword")).alias("a")).where("a <> ''").distinct()
    fields = F.array(*(F.lower(X.lit_empty(F.col(c))) for c in ("name", "description", "tags_text")))
    texts = nodes.select("id", F.explode(F.array_distinct(fields)).alias("b")).where("b <> ''")
    found = similarity.inside(*similarity.ordered_bigrams(asked.select(F.col("a").alias("s")), texts.select(F.col("b").alias("s"))))
    return asked.join(found, "a").join(texts, "b").select("question", F.col("id").alias("seed")).distinct()


def search(nodes: DataFrame, edges: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """G18. question, place, hops, ids, types, edges, path of the first ``limit`` paths of one
    or two steps from a question's seeds, along edges in either direction, no edge twice.

    The order is by steps, seed and edges. Only the ``limit`` + 1 least edges of a node can
    be in it: a seed with ``limit`` edges of its own has no place for a second step, and
    one with fewer is followed along all of them. They are kept before any join, so a hub
    brings no more rows than another node.
    """
    ends = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "id", "type").union(edges.select("dst", "src", "id", "type")).distinct()
    by = Window.partitionBy("at").orderBy("id", "to")
    near = checkpointed(ends.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit + 1).drop("n"))
    found = seeds(nodes, questions)
    one = found.join(near.where("at IS NOT NULL"), F.col("seed") == F.col("at")).select("question", "seed", F.array("seed", "to").alias("ids"), F.array("type").alias("types"), F.array("id").alias("via"))
    then = near.select(F.col("at").alias("__at"), F.col("to").alias("__to"), F.col("id").alias("__id"), F.col("type").alias("__type"))
    two = one.join(then, (F.element_at("ids", -1) == F.col("__at")) & ~F.array_contains("via", F.col("__id")))
    two = two.select("question", "seed", F.concat("ids", F.array("__to")).alias("ids"), F.concat("types", F.array("__type")).alias("types"), F.concat("via", F.array("__id")).alias("via"))
    first = Window.partitionBy("question").orderBy(F.size("via"), "seed", "via", "ids")
    best = one.union(two).withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    # a few rows a question: names of the nodes on them
    steps = best.select("question", "place", F.posexplode("ids").alias("pos", "id")).join(nodes.select("id", "label", "name"), "id", "left")
    named = steps.groupBy("question", "place").agg(F.sort_array(F.collect_list(F.struct("pos", "label", F.coalesce("name", F.lit("")).alias("name")))).alias("x"))
    pairs = F.transform("types", lambda t, i: F.struct(F.get("ids", i).alias("source"), F.get("ids", i + 1).alias("target"), t.alias("type")))
    return best.join(named, ["question", "place"]).select(
        "question", "place", F.size("via").alias("hops"), "ids", "types", pairs.alias("edges"), X.path_text(F.col("x.label"), F.col("x.name"), F.col("types")).alias("path")
    )


def subgraph(nodes: DataFrame, paths: DataFrame, participants: DataFrame, first: int = 5, top_k: int = 10) -> DataFrame:
    """G19, U6. question, kind, source, target, label: the subgraph of each question's ``paths``
    (of ``search``), each row once.

    Kinds: node (source its id, label its label), edge (label its type) and path (label its
    text, target its place; the first of equal ones). The ``first`` nodes of a question are
    expanded together, each by its ``top_k`` neighbours over two steps of ``participants``;
    a neighbour that is on no path is a node, and the edge to it is RELATED_TO.
    """
    paths = checkpointed(paths)
    hits = paths.select("question", "place", F.posexplode("ids").alias("pos", "id"))
    known = hits.select("question", "id").distinct()
    start = hits.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("place", "pos"))).where(F.col("n") <= first).select("question", "id").distinct()
    # a node that several questions start from is expanded once
    around = hypergraph.khop_neighbours(participants, start.select(F.col("id").alias("node_id")), 2, top_k).select(F.col("node_id").alias("id"), F.col("neighbour_id").alias("target"))
    new = start.join(around, "id").join(known.select("question", F.col("id").alias("target")), ["question", "target"], "left_anti").select("question", "id", "target")
    held = known.union(new.select("question", "target")).distinct().join(nodes.select("id", "label").dropDuplicates(["id"]), "id")
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    rows = held.select("question", F.lit("node").alias("kind"), text("id").alias("source"), none.alias("target"), "label")
    edges = paths.select("question", F.inline("edges")).select("question", F.lit("edge"), text("source"), text("target"), "type")
    related = new.join(nodes.select(F.col("id").alias("target")).distinct(), "target").select("question", F.lit("edge"), text("id"), text("target"), F.lit("RELATED_TO"))
    shown = paths.where("path <> ''").groupBy("question", "path").agg(F.min("place").alias("place")).select("question", F.lit("path"), none, text("place"), "path")
    return rows.union(edges).union(related).union(shown).distinct()
