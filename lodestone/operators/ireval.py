"""Retrieval metrics over rankings and judgments.

rankings: query_id, doc_id, rank (from 1). judgments: query_id, doc_id, gain (graded, may be 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAIN_CUT, RECALL_CUT = 10, 100


def document_ranks(segments: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """A document ranks by its best segment; ties by id."""
    best = segments.groupBy(query_id, doc_id).agg(F.min("rank").alias("_best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("_best", doc_id)).cast("long")).drop("_best")


def without_self(rankings: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Rankings without the query's own document, closed up."""
    rest = rankings.where(~F.col(query_id).eqNullSafe(F.col(doc_id)))
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("rank")).cast("long"))


def metrics(rankings: DataFrame, judgments: DataFrame, graded: bool = True) -> DataFrame:
    """query_id, ndcg_10, recall_100, mrr_10 for each judged query; unjudged documents keep their ranks and gain nothing."""
    gain = F.col("gain") if graded else F.when(F.col("gain") > 0, 1).otherwise(0)
    good = judgments.where("gain > 0").select("query_id", "doc_id", gain.cast("double").alias("gain"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))
    ideal = good.withColumn("_place", place).groupBy("query_id").agg(_dcg(F.col("gain"), F.col("_place")).alias("_ideal"), F.count("*").alias("_good"))
    hits = rankings.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(
        _dcg(F.col("gain"), F.col("rank")).alias("_dcg"), F.count_if(F.col("rank") <= RECALL_CUT).alias("_found"), F.min(F.when(F.col("rank") <= GAIN_CUT, F.col("rank"))).alias("_first")
    )
    asked = judgments.select("query_id").distinct()
    zero = F.lit(0.0)
    return asked.join(ideal, "query_id", "left").join(hits, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("_dcg") / F.nullif("_ideal", zero), zero).alias("ndcg_10"),
        F.coalesce(F.col("_found") / F.col("_good"), zero).alias("recall_100"),
        F.coalesce(1.0 / F.col("_first"), zero).alias("mrr_10"),
    )


def _dcg(gain: Column, place: Column) -> Column:
    """Summed in the order of places, so that equal inputs give equal bits."""
    parts = F.sort_array(F.collect_list(F.when(place <= GAIN_CUT, F.struct(place.alias("p"), (gain / F.log2(place + 1)).alias("x")))))
    return F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + s["x"])


def macro(per_query: DataFrame, *names: str) -> DataFrame:
    """Means over queries, 0 without any."""
    return per_query.agg(F.count("*").alias("n_queries"), *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def percentile(values: Column, fraction: float) -> Column:
    """The value at index int(fraction * (n - 1)) of the sorted ones."""
    got = F.sort_array(F.collect_list(values))
    return F.element_at(got, (F.lit(fraction) * (F.size(got) - 1)).cast("int") + 1)


def percentiles(df: DataFrame, value: str, fractions: dict[str, float], by: list[str]) -> DataFrame:
    """The same by rank in a window, so that a group needn't fit into one row."""
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy(value)) - 1
    n = F.count("*").over(w)
    placed = df.where(F.col(value).isNotNull()).select(*by, value, at.alias("_at"), n.alias("_n"))
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("_at") == F.floor(F.lit(f) * (F.col("_n") - 1)), F.col(value))).alias(name) for name, f in fractions.items()])


def coverage(selected: DataFrame, judgments: DataFrame, by: list[str]) -> DataFrame:
    """Share of all judged documents (any gain) that were selected; a document counts once."""
    judged = judgments.select("query_id", "doc_id").distinct()
    n = judged.groupBy("query_id").agg(F.count("*").alias("n_judged"))
    hit = selected.select(*by, "query_id", "doc_id").distinct().join(judged, ["query_id", "doc_id"]).groupBy(*by, "query_id").agg(F.count("*").alias("n_hit"))
    runs = selected.select(*by).distinct()
    out = n.crossJoin(F.broadcast(runs)).join(hit, [*by, "query_id"], "left")  # runs: one row per budget
    return out.select(*by, "query_id", (F.coalesce("n_hit", F.lit(0)) / F.col("n_judged")).alias("coverage"))


def coverage_curve(per_query: DataFrame) -> DataFrame:
    """budget, n_queries, coverage, selected (whole mean), used (whole mean), utilisation; per_query: budget, query_id, coverage, n_selected, used_bytes."""
    sums = per_query.groupBy("budget").agg(F.count("*").alias("n_queries"), F.avg("coverage").alias("coverage"), F.sum("n_selected").alias("_s"), F.sum("used_bytes").alias("_u"))
    used = F.expr("_u div n_queries")
    return sums.select("budget", "n_queries", "coverage", F.expr("_s div n_queries").alias("selected"), used.alias("used"), (used / F.col("budget")).alias("utilisation"))


def comparable(reports: DataFrame, axes: list[str]) -> DataFrame:
    """Axes on which reports differ: they may be compared if there are none."""
    counts = reports.agg(*[F.countDistinct(F.coalesce(F.col(a).cast("string"), F.lit("\x00"))).alias(a) for a in axes])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("n_values")) for a in axes])).alias("x")).select("x.*").where("n_values > 1")


def compare(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """One row: queries, identical rankings, first query that differs, differences of mean metrics. Inputs: query_id, ranked (array) and metrics."""
    a = left.select("query_id", F.col("ranked").alias("_a"), *[F.col(n).alias(f"_a_{n}") for n in names])
    b = right.select("query_id", F.col("ranked").alias("_b"), *[F.col(n).alias(f"_b_{n}") for n in names])
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, "query_id", "full").agg(
        F.count("*").alias("n_queries"),
        F.count_if(same).alias("n_identical"),
        F.min(F.when(~same, F.col("query_id"))).alias("first_difference"),
        *[(F.coalesce(F.avg(f"_b_{n}"), F.lit(0.0)) - F.coalesce(F.avg(f"_a_{n}"), F.lit(0.0))).alias(f"delta_{n}") for n in names],
    )


def rescored(saved: DataFrame, judgments: DataFrame) -> DataFrame:
    """run, n_queries, mean ndcg_10, recall_100 and mrr_10, the same gain by yes and no, results removed as the query itself, and ndcg_10 with them.

    saved: run, query_id, ranked (array of document ids, best first). Means are over the queries of a run that have judgments, and 0 without any.
    """
    key = F.struct("run", "query_id")
    rows = saved.select(key.alias("query_id"), F.posexplode("ranked").alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)
    own = F.col("doc_id").cast("string") == F.col("query_id.query_id").cast("string")
    order = Window.partitionBy("query_id").orderBy("rank")
    others = rows.where(~own).withColumn("rank", F.row_number().over(order))
    asked = judgments.join(saved.select("run", "query_id").distinct(), "query_id").select(key.alias("query_id"), "doc_id", "gain")
    plain, binary, whole = metrics(others, asked), metrics(others, asked, graded=False), metrics(rows, asked)
    both = plain.join(binary.select("query_id", F.col("ndcg_10").alias("binary_ndcg_10")), "query_id").join(whole.select("query_id", F.col("ndcg_10").alias("ndcg_10_with_self")), "query_id")
    names = ("ndcg_10", "recall_100", "mrr_10", "binary_ndcg_10", "ndcg_10_with_self")
    means = both.groupBy("query_id.run").agg(F.count("*").alias("n_queries"), *[F.avg(n).alias(n) for n in names])
    removed = rows.groupBy("query_id.run").agg(F.count_if(own).alias("n_self_removed"))
    out = saved.select("run").distinct().join(means, "run", "left").join(removed, "run", "left")
    return out.select("run", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_queries", "n_self_removed")], *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def invalid_rankings(rankings: DataFrame) -> DataFrame:
    """Queries that rank a document twice."""
    return rankings.groupBy("query_id").agg(F.count("*").alias("n_ranked"), F.countDistinct("doc_id").alias("n_distinct")).where("n_ranked <> n_distinct")


def phase_summary(timings: DataFrame, phase: str, value: str, error: str) -> DataFrame:
    """Count, p50, p99, maximum, and errors of each phase (index int(q * n), the last at most)."""
    w = Window.partitionBy(phase)
    placed = timings.select(phase, value, error, (F.row_number().over(w.orderBy(value)) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    pick = lambda q: F.max(F.when(F.col("_at") == F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1), F.col(value)))
    return placed.groupBy(phase).agg(F.count("*").alias("n"), pick(0.5).alias("p50"), pick(0.99).alias("p99"), F.max(value).alias("most"), F.count(error).alias("n_errors"))
