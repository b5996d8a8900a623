"""The k-hop query works for each fiftieth part, and over orders of any size."""

from pyspark.sql import functions as F

from caselens.plans.graph import g14_khop


def test_seeds_and_large_orders(spark, tmp_path):
    lines = [(1, n, "N") for n in range(50, 60)] + [(2, 100, "N"), (2, 101, "A"), (3, 1, "N"), (3, 2, "N")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 151).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5).select(F.col("id").cast("int").alias("r_regionkey")).write.parquet(f"{tmp_path}/region.parquet")
    found = {(r.node_id, r.neighbour_id) for r in g14_khop(spark, str(tmp_path)).collect()}
    assert found == {(50, n) for n in range(51, 60)} | {(100, 101)}
