"""Greedy packing of ranked candidates into a budget. A list of candidates is one query's top, so a fold over an array is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gathered(ranked: DataFrame, query_id: str, *fields: str) -> DataFrame:
    """One row per query: ``candidates``, structs in rank order."""
    return ranked.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("candidates"))


def pack(candidates: Column, budget: Column | int, size: str = "bytes") -> Column:
    """Struct (used, flags): each candidate in order is taken if it fits in what is left; others are passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))

    def step(acc: Column, c: Column) -> Column:
        fits = acc["used"] + c[size] <= F.lit(budget)
        return F.struct((acc["used"] + F.when(fits, c[size]).otherwise(0)).cast("long").alias("used"), F.concat(acc["flags"], F.array(fits)).alias("flags"))

    return F.aggregate(candidates, start, step)


def pack_distinct(candidates: Column, budget: Column | int, size: str = "bytes", digest: str = "content_sha256", key: str = "segment_id") -> Column:
    """Struct (used, seen, marks): a text equal to a selected one is a duplicate of it, whether or not it would fit."""
    mark = "struct<selected:boolean,omission:string,duplicate_of:string>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.create_map().cast("map<string,string>").alias("seen"), F.array().cast(f"array<{mark}>").alias("marks"))

    def step(acc: Column, c: Column) -> Column:
        twin = F.try_element_at(acc["seen"], c[digest])
        fits = twin.isNull() & (acc["used"] + c[size] <= F.lit(budget))
        omission = F.when(twin.isNotNull(), "duplicate").when(~fits, "budget")
        note = F.struct(fits.alias("selected"), omission.alias("omission"), twin.alias("duplicate_of")).cast(mark)
        return F.struct(
            (acc["used"] + F.when(fits, c[size]).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.map_concat(acc["seen"], F.create_map(c[digest], c[key]))).otherwise(acc["seen"]).alias("seen"),
            F.concat(acc["marks"], F.array(note)).alias("marks"),
        )

    return F.aggregate(candidates, start, step)


def until_full(ranked: DataFrame, query_id: str, size: str, budget: int) -> DataFrame:
    """Candidates before the first that would overflow."""
    order = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum(size).over(order)).where(F.col("running") <= budget)


def selected(packed: DataFrame, flags: str) -> Column:
    """Candidates whose flag is set."""
    pairs = F.arrays_zip("candidates", flags)
    return F.transform(F.filter(pairs, lambda p: p[flags]), lambda p: p["candidates"])
