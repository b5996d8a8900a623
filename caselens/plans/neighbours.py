"""Queries over the order-part hypergraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens import bindings
from caselens.operators import hypergraph


def g13_weighted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergraph.weighted_neighbours(bindings.participants(spark, sf_dir))


QUERIES = {"g13_weighted_neighbours": g13_weighted_neighbours}

ORACLE_SQL = {
    "g13_weighted_neighbours": """
WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS n FROM lineitem),
r AS (SELECT e, CAST(1.0 / count(*) AS DECIMAL(18,6)) AS w FROM m GROUP BY e HAVING count(*) > 1)
SELECT a.n AS node_id, b.n AS neighbour_id, CAST(sum(w) AS DECIMAL(18,6)) AS similarity, count(*) AS shared
FROM m a JOIN r USING (e) JOIN m b USING (e) WHERE a.n <> b.n GROUP BY ALL""",
}
