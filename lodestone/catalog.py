"""All queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import canonical, evaluation, lifecycle, records, search, structure, texts, verification
from .runtime import ship_package

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (texts, structure, lifecycle, evaluation, records, verification, canonical)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search of all benchmark texts over all documents, packed into a budget."""
    documents, queries_ = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    segments = search.segments_of(documents)
    found = search.search(segments, queries_.selectExpr("item_id as query_id", "text"))
    return search.selection(segments, found)


def _shipped(run: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Query]:
    return {name: _shipped(run) for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
