"""Registered queries: a function of (spark, sf_dir) each, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; it gets ``t``, which reads a table by its name."""

    def register(work: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
            return work(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[work.__name__] = run
        if sql:
            ORACLE_SQL[work.__name__] = sql
        return work

    return register


from quillgraph.plans import queries_graph, queries_library, queries_search, queries_tables  # noqa: E402,F401  they register themselves
