"""Scoring of questions whose answers are passages of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaps(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Results that touch an answer's byte range in the same source, or that contain its anchor where it has no range.

    results: question, source, rank, start, stop, text. answers: question, passage_group, passage, source, start, stop, anchor.
    """
    r = results.select("question", "source", "rank", F.col("start").alias("_rs"), F.col("stop").alias("_re"), "text")
    ranged = F.col("start").isNotNull()
    touch = (ranged & (F.col("_rs") < F.col("stop")) & (F.col("start") < F.col("_re"))) | (~ranged & F.contains(F.col("text"), F.col("anchor")))
    return r.join(answers, ["question", "source"]).where(touch).select("question", "passage_group", "passage", "rank")


def covers(results: DataFrame, answers: DataFrame) -> DataFrame:
    """question, passage, covered: whether the results' ranges, stitched, cover the whole answer."""
    r = results.select("question", "source", F.col("start").alias("_rs"), F.col("stop").alias("_re"))
    near = r.join(answers, ["question", "source"]).where((F.col("_rs") <= F.col("stop")) & (F.col("start") <= F.col("_re")))
    order = Window.partitionBy("question", "passage").orderBy("_rs", "_re").rowsBetween(Window.unboundedPreceding, -1)
    stitched = near.withColumn("_reach", F.greatest(F.coalesce(F.max("_re").over(order), F.col("start")), F.col("start")))
    stitched = stitched.withColumn("_hole", (F.col("_rs") > F.col("_reach")) & (F.col("_reach") < F.col("stop")))
    done = stitched.groupBy("question", "passage").agg((~F.bool_or("_hole") & (F.max("_re") >= F.first("stop"))).alias("covered"))
    return answers.select("question", "passage").join(done, ["question", "passage"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def score(hits: DataFrame, questions: DataFrame, groups: DataFrame) -> DataFrame:
    """question, corpus, groups_covered, n_groups, answered (all groups), rank (of the group covered last)."""
    best = hits.groupBy("question", "passage_group").agg(F.min("rank").alias("_rank"))
    per = groups.join(best, ["question", "passage_group"], "left").groupBy("question")
    each = per.agg(F.count("*").alias("n_groups"), F.count("_rank").alias("groups_covered"), F.max("_rank").alias("_last"))
    out = questions.join(each, "question", "left")
    answered = F.coalesce(F.col("groups_covered") == F.col("n_groups"), F.lit(False))
    return out.select("question", "corpus", F.coalesce("groups_covered", F.lit(0)).alias("groups_covered"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), answered.alias("answered"), F.when(answered, F.col("_last")).alias("rank"))


def summary(scored: DataFrame) -> DataFrame:
    """By corpus, and overall where corpus is null: questions, answered, share of groups covered, median rank."""
    return scored.rollup("corpus").agg(
        F.count("*").alias("n_questions"), F.count_if("answered").alias("n_answered"), (F.sum("groups_covered") / F.sum("n_groups")).alias("group_coverage"), F.percentile("rank", F.lit(0.5)).alias("median_rank")
    )


def halves(questions: DataFrame, salt: str, kind: str = "kind", key: str = "question") -> DataFrame:
    """Each kind's questions dealt in turn to halves 0 and 1, in the order of a salted digest."""
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    order = Window.partitionBy(kind).orderBy("_digest")
    return questions.withColumn("_digest", digest).withColumn("half", ((F.row_number().over(order) - 1) % 2).cast("long")).drop("_digest")
