"""Cards take their concepts from the whole text."""

from pyspark.sql import functions as F

from caselens.operators import cards as operator
from caselens.plans import cards


def test_concepts_of_the_whole_text(spark, tmp_path):
    text = "short " * 60 + " ".join(f"concept{k}" for k in range(9))
    spark.createDataFrame([(1, text, "en", "web")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.kind: r.n for r in cards.g11_backfill(spark, str(tmp_path)).collect()}
    assert got["involves"] == 11  # the card, "short" and nine concepts
    assert [r.object for r in cards.g9_triples(spark, str(tmp_path)).collect() if r.object.startswith("concept")]


def test_backfill_takes_every_association_of_concepts(spark):
    """More associations between concepts than any cap that there was (5,000), each given twice."""
    one = spark.createDataFrame([("card1", "web")], "name string, industry string")
    pairs = spark.range(7001).select(F.lit("ASSOCIATED_WITH").alias("type"), F.lit("Concept").alias("src_label"), F.concat(F.lit("a"), F.col("id") % 83).alias("src"), F.lit("Concept").alias("dst_label"), F.concat(F.lit("b"), "id").alias("dst"))
    prereq = operator.backfill(one, pairs.union(pairs))["prereq"]
    assert prereq.count() == 7001 and prereq.distinct().count() == 7001
