"""Every registered query of the case operators, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.plans import cards, casegraphs, caserules, classroom, documents, evidence, graph, links, neighbours, records, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (neighbours, classroom, documents, graph, caserules, casegraphs, cards, records, links, evidence, streams):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
