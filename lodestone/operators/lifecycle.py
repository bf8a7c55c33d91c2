"""Items over time: snapshots, changelogs, receipts, and the tables that hold the present state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["source", "item"]


def latest(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def snapshot_actions(current: DataFrame, incoming: DataFrame, key: list[str] = KEY, digest: str = "digest") -> DataFrame:
    """key, action: what a full listing does to the present items (``active``, digest); what it lacks is deleted."""
    return _actions(current, incoming.withColumn("deleted", F.lit(False)), key, digest, absent="deleted")


def changelog_actions(current: DataFrame, incoming: DataFrame, key: list[str] = KEY, digest: str = "digest") -> DataFrame:
    """key, action: what a stream of changes (digest, deleted) does; what it lacks stays."""
    return _actions(current, incoming, key, digest, absent=None)


def _actions(current: DataFrame, incoming: DataFrame, key: list[str], digest: str, absent: str | None) -> DataFrame:
    now = current.select(*key, F.col("active").alias("_active"), F.col(digest).alias("_was"))
    new = incoming.select(*key, "deleted", F.col(digest).alias("_new"), F.lit(True).alias("_in"))
    both = now.join(new, key, "full")
    known, active = F.col("_active").isNotNull(), F.coalesce("_active", F.lit(False))
    action = (
        F.when(F.col("_in").isNull(), F.when(active, F.lit(absent)))
        .when(F.col("deleted"), F.when(active, "deleted").otherwise("absent"))
        .when(~known, "added")
        .when(~active, "restored")
        .when(F.col("_was").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    return both.select(*key, action.alias("action")).where("action is not null")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def replay(current: DataFrame, changes: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """Present items after a changelog: the last change of each key wins."""
    last = latest(changes, key, order).select(*key, F.col("digest"), (~F.col("deleted")).alias("active"))
    kept = current.select(*key, "digest", "active").join(last.select(*key), key, "left_anti")
    return kept.unionByName(last)


def insert_or_verify(stored: DataFrame, incoming: DataFrame, key: str, body: str) -> DataFrame:
    """key, body, verdict: ``new``, ``same`` (nothing to do) or ``conflict`` (the key is stored with another body)."""
    old = stored.select(key, F.col(body).alias("_old"))
    joined = incoming.select(key, body).distinct().join(old, key, "left")
    clash = F.count("*").over(Window.partitionBy(key)) > 1
    verdict = F.when(clash | (F.col("_old").isNotNull() & (F.col("_old") != F.col(body))), "conflict").when(F.col("_old").isNull(), "new").otherwise("same")
    return joined.select(key, body, verdict.alias("verdict"))


def without_index(index: DataFrame, dropped: DataFrame, key: str = "representation_id") -> DataFrame:
    """Index rows but those of dropped representations."""
    return index.join(dropped.select(key), key, "left_anti")


def vanished(before: DataFrame, now: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Items active before and not listed now."""
    return before.select(*key).join(now.select(*key), key, "left_anti")


def checkpoint_violations(receipts: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Pull receipts whose expected checkpoint isn't the one that the last receipt stored."""
    before = F.lag("next").over(Window.partitionBy(source).orderBy(seq))
    return receipts.withColumn("stored", before).where(~F.col("expected").eqNullSafe(F.col("stored")))


def sequence_verdicts(pushes: DataFrame, source: str = "source", order: str = "arrival", sequence: str = "sequence", gap: str = "gap") -> DataFrame:
    """Push deliveries with ``high`` before them and a verdict.

    gap: struct(start, stop) or null. First, next and late numbers want no gap; a jump wants exactly the gap it makes.
    A rejected delivery doesn't move the high mark; as a rejected number is above it, the batch form holds only up to a
    source's first rejection, after which rows are ``unknown``; the streaming form goes on.
    """
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = pushes.withColumn("high", F.max(sequence).over(w))
    s, high, none = F.col(sequence), F.col("high"), F.col(gap).isNull()
    fits = ~none & (F.col(gap)["start"] == high + 1) & (F.col(gap)["stop"] == s)
    verdict = (
        F.when(s.isNull(), F.when(none, "unnumbered").otherwise("invalid"))
        .when(high.isNull(), F.when(none, "first").otherwise("invalid"))
        .when(s <= high, F.when(none, "late").otherwise("invalid"))
        .when(s == high + 1, F.when(none, "next").otherwise("invalid"))
        .otherwise(F.when(fits, "jump").otherwise("invalid"))
    )
    out = out.withColumn("verdict", verdict)
    broken = F.max((F.col("verdict") == "invalid").cast("int")).over(w)
    return out.withColumn("verdict", F.when(F.coalesce(broken, F.lit(0)) == 1, "unknown").otherwise(F.col("verdict")))


def source_states(receipts: DataFrame, withdrawals: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """source, state, withdrawal: active after a receipt, withdrawn after a withdrawal, whichever came last."""
    rows = receipts.select(source, seq, F.lit("active").alias("state"), F.lit(None).cast("string").alias("withdrawal"))
    rows = rows.unionByName(withdrawals.select(source, seq, F.lit("withdrawn").alias("state"), F.col("withdrawal").cast("string").alias("withdrawal")))
    return latest(rows, [source], seq)


def delivery_shape_holds(initiative: str = "initiative", form: str = "form"):
    """Pull brings checkpoints and no sequence, push no checkpoints; snapshots and stream windows cover a time, items don't."""
    c = F.col
    span = c("covered_from").isNotNull() & c("covered_to").isNotNull() & (c("covered_from") < c("covered_to"))
    bare = c("covered_from").isNull() & c("covered_to").isNull()
    way = F.when(c(initiative) == "pull", c("next").isNotNull() & c("sequence").isNull()).when(c(initiative) == "push", c("next").isNull() & c("expected").isNull()).otherwise(False)
    time = F.when(c(form) == "item", bare).when(c(form).isin("snapshot", "stream_window"), span).otherwise(False)
    return way & time
