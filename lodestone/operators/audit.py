"""Whole-store checks. Each gives the rows that break a rule; a store is sound if all are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sequence_gaps(log: DataFrame, seq: str = "seq", first: int = 1) -> DataFrame:
    """seq, before: numbers that don't follow the one before (the first must be ``first``).

    Numbers are compared inside ranges, and the first of each range with the last of the
    range before, so that no task sorts the whole log.
    """
    rows = log.select(F.col(seq).cast("long").alias("seq")).withColumn("_range", F.floor(F.col("seq") / 65536))
    inside = Window.partitionBy("_range").orderBy("seq")
    ends = rows.groupBy("_range").agg(F.max("seq").alias("_last"))
    # One row per 65 536 numbers.
    before = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    joined = rows.withColumn("before", F.lag("seq").over(inside)).join(before, "_range")
    joined = joined.select("seq", F.coalesce("before", "_carried", F.lit(first - 1)).cast("long").alias("before"))
    return joined.where("seq <> before + 1")


def log_without_record(log: DataFrame, records: dict[str, DataFrame], record_id: str = "record_id") -> DataFrame:
    """Leaves whose record isn't in the table of their kind."""
    out = None
    for kind, table in records.items():
        lost = log.where(F.col("kind") == kind).join(table.select(record_id), record_id, "left_anti")
        out = lost if out is None else out.unionByName(lost)
    return out


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return children.join(parents.select(*on), on, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    only = left.select(*on).distinct().join(right.select(*on), on, "left_anti").withColumn("side", F.lit("left"))
    return only.unionByName(right.select(*on).distinct().join(left.select(*on), on, "left_anti").withColumn("side", F.lit("right")))


def count_mismatches(counts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, left, right of pairs of tables whose row counts differ."""
    out = None
    for name, (a, b) in counts.items():
        both = a.agg(F.count("*").alias("left")).crossJoin(b.agg(F.count("*").alias("right"))).select(F.lit(name).alias("name"), "left", "right")  # one row each
        out = both if out is None else out.unionByName(both)
    return out.where("left <> right")


def incomplete_index(segments: DataFrame, index: DataFrame, group: str, key: str = "segment_id") -> DataFrame:
    """group, n_segments, n_indexed of groups whose segments aren't all indexed."""
    have = index.select(key).distinct().withColumn("_has", F.lit(1))
    return segments.join(have, key, "left").groupBy(group).agg(F.count("*").alias("n_segments"), F.count("_has").alias("n_indexed")).where("n_segments <> n_indexed")


def derived_differently(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of a stored table that deriving it anew doesn't give, and the other way round."""
    names = stored.columns
    a, b = stored.select(*names), derived.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("derived")))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n_rows of all checks."""
    out = None
    for name, rows in checks.items():
        n = rows.agg(F.lit(name).alias("check"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


def consecutive_rank_violations(rows: DataFrame, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """Ranks of a query that don't run 1, 2, 3."""
    before = F.coalesce(F.lag(rank).over(Window.partitionBy(query_id).orderBy(rank)), F.lit(0))
    return rows.withColumn("before", before).where(F.col(rank) != F.col("before") + 1)
