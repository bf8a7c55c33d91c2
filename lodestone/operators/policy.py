"""Access and lifecycle: what a query may return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def current_access(events: DataFrame, source: str = "source_id", seq: str = "seq", access: str = "access") -> DataFrame:
    """The last event of each source in log order."""
    return events.groupBy(source).agg(F.max_by(access, seq).alias("access"), F.max(seq).alias("seq"))


def time_violations(events: DataFrame, source: str = "source_id", seq: str = "seq", time: str = "time") -> DataFrame:
    """Events that aren't later than the one before of their source."""
    before = F.lag(time).over(Window.partitionBy(source).orderBy(seq))
    return events.withColumn("before", before).where(F.col(time) <= F.col("before"))


def next_time(now: Column, last: Column) -> Column:
    """A new event's time: now, or just after the last event."""
    return F.greatest(now, F.coalesce(last + 1, now))


def appended(wanted: DataFrame, current: DataFrame, source: str = "source_id") -> DataFrame:
    """Of the wanted settings (source, access, only_if_unset) those that make a new event."""
    now = current.select(source, F.col("access").alias("_now"))
    unset = F.col("_now").isNull()
    return wanted.join(now, source, "left").where(unset | (~F.col("only_if_unset") & (F.col("_now") != F.col("access")))).drop("_now")


def outcomes(sources: DataFrame, states: DataFrame, access: DataFrame, source: str = "source_id") -> DataFrame:
    """reasons (in order) and outcome of each source: missing state, withdrawn, no access set, access denied; any denies."""
    joined = sources.join(states.select(source, "state"), source, "left").join(access.select(source, "access"), source, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("state").isNull(), "missing_state"),
            F.when(F.col("state") == "withdrawn", "withdrawn"),
            F.when(F.col("access").isNull(), "access_default").when(F.col("access") == "deny", "access_denied"),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn("outcome", F.when(F.size("reasons") == 0, "allow").otherwise("deny"))


def dispositions(candidates: DataFrame, evidence: DataFrame, states: DataFrame, key: str = "segment_id", source: str = "source_id") -> DataFrame:
    """Candidates with disposition and reasons from the states of all their sources; rejected texts are blanked."""
    seen = evidence.select(key, source).distinct().join(states.select(source, "state"), source, "left")
    flags = seen.groupBy(key).agg(F.bool_or(F.coalesce(F.col("state") == "withdrawn", F.lit(False))).alias("_withdrawn"), F.bool_or(F.col("state").isNull()).alias("_missing"))
    out = candidates.join(flags, key, "left")
    reasons = F.array_compact(F.array(F.when(F.col("_withdrawn"), "source_withdrawn"), F.when(F.coalesce("_missing", F.lit(True)), "source_state_missing")))
    out = out.withColumn("reasons", reasons).withColumn("disposition", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected"))
    return out.withColumn("text", F.when(F.col("disposition") == "accepted", F.col("text")).otherwise("")).drop("_withdrawn", "_missing")


def final_ranks(judged: DataFrame, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """Ranks from 1 among accepted candidates only, 0 for rejected ones."""
    yes = F.when(F.col("disposition") == "accepted", 1).otherwise(0)
    running = F.sum(yes).over(Window.partitionBy(query_id).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("final_rank", F.when(yes == 1, running).otherwise(0).cast("long"))


def lexical_outcome(denied: Column, active: Column, n_evidence: Column, n_omitted: Column, n_rejected: Column) -> Column:
    """What became of a query, first that holds."""
    return (
        F.when(denied & ~active, "lifecycle_excluded")
        .when(denied, "policy_excluded")
        .when(n_evidence > 0, "evidence")
        .when(n_omitted > 0, "budget_omitted")
        .when(n_rejected > 0, "lifecycle_excluded")
        .otherwise("no_matches")
    )


def vector_outcome(denied: Column, n_evidence: Column, n_passages: Column, n_found: Column, found_name: str = "no_indexed_passages") -> Column:
    """As above for vector queries, and with "no_candidates" for fused ones."""
    return F.when(denied, "policy_excluded").when(n_evidence > 0, "evidence").when(n_passages == 0, "no_passages").when(n_found == 0, found_name).otherwise("budget_omitted")
