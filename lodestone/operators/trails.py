"""Records of what a query selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I


def exploded(trails: DataFrame, trail_id: str = "trail_id") -> DataFrame:
    """One row per candidate, in order."""
    return trails.select(trail_id, F.posexplode("candidates").alias("position", "c")).select(trail_id, (F.col("position") + 1).cast("long").alias("position"), "c.*")


def gathered(rows: DataFrame, trail_id: str = "trail_id") -> DataFrame:
    """The inverse of ``exploded``."""
    rest = [c for c in rows.columns if c not in (trail_id, "position")]
    ordered = rows.groupBy(trail_id).agg(F.sort_array(F.collect_list(F.struct("position", *rest))).alias("_c"))
    return ordered.select(trail_id, F.transform("_c", lambda c: F.struct(*[c[r].alias(r) for r in rest])).alias("candidates"))


def trail_id(schema: str, request: Column, decision: Column, outcome: Column, expression: Column, budget: Column, used: Column, packet: Column, candidates: Column) -> Column:
    """candidates: structs segment_id, content_sha256, rank, bytes, disposition, selected, reasons (array)."""

    def one(c: Column) -> Column:
        flag = F.when(c["selected"], F.unhex(F.lit("0100000000000000"))).otherwise(F.unhex(F.lit("0000000000000000")))
        head = [I.field("candidate"), I.field(I.raw(c["segment_id"])), I.field(I.raw(c["content_sha256"])), I.field(I.u64(c["rank"])), I.field(I.u64(c["bytes"])), I.field(c["disposition"]), I.field(flag)]
        reasons = F.aggregate(c["reasons"], F.lit(b""), lambda acc, r: F.concat(acc, I.field(r)))
        return F.concat(*head, reasons, I.field("end"))

    body = F.aggregate(F.transform(candidates, one), F.lit(b""), lambda acc, x: F.concat(acc, x))
    head = [I.field(schema), I.field(I.raw(request)), I.field(I.raw(decision)), I.field(outcome), I.field(expression), I.field(I.u64(budget)), I.field(I.u64(used)), I.field(I.raw(packet))]
    return F.sha2(F.concat(*head, body), 256)


def view(candidates: Column) -> Column:
    """What an inspection may show: accepted candidates whole, and the number of others."""
    accepted = F.filter(candidates, lambda c: c["disposition"] == "accepted")
    return F.struct(accepted.alias("candidates"), (F.size(candidates) - F.size(accepted)).cast("long").alias("n_rejected"))


def of_source(trails: DataFrame, rows: DataFrame, segments: DataFrame, source: Column) -> DataFrame:
    """Trails with a candidate of the source."""
    mine = rows.join(segments.where(source).select("segment_id"), "segment_id", "left_semi").select("trail_id").distinct()
    return trails.join(mine, "trail_id", "left_semi")


def indexed_now(rows: DataFrame, index: DataFrame, key: str = "segment_id") -> DataFrame:
    """Candidates with whether the index still has them."""
    return rows.join(index.select(key).distinct().withColumn("_has", F.lit(True)), key, "left").withColumn("indexed_now", F.col("_has").isNotNull()).drop("_has")


def totals(rows: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Bytes used and considered, selected, duplicates and over budget, by query."""
    yes = F.col("selected")
    return rows.groupBy(query_id).agg(
        F.coalesce(F.sum(F.when(yes, F.col("bytes"))), F.lit(0)).alias("used_bytes"),
        F.sum("bytes").alias("considered_bytes"),
        F.count_if(yes).alias("n_selected"),
        F.count_if(F.col("omission") == "duplicate").alias("n_duplicate"),
        F.count_if(F.col("omission") == "budget").alias("n_budget"),
    )
