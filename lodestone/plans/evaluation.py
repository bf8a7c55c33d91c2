"""Queries on vectors, fusion, retrieval metrics, and question scoring.

Judgments for the checks: a benchmark text judges the documents of labels whose id has the same remainder by seven;
quality is the gain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..operators import ireval, questions, vectors
from ..operators.lexical import ranked
from ..tables import Scratch
from . import search as S
from .sql import SCORES, with_

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Vectors: queries are all rows whose id 20 divides, against all rows.


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("values"))


COSINES = """good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
cosines AS (SELECT q.vec_id AS query_id, c.vec_id, q.label AS query_label, c.label, round(greatest(-1, least(1, list_cosine_similarity(c.v, q.v))), 9) AS score FROM good q JOIN good c ON true WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines)"""


def _near(spark: SparkSession, d: str, limit: int | None = 10) -> DataFrame:
    all_ = _vectors(spark, d)
    asked = all_.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "values")
    return vectors.exact_neighbours(all_, asked, limit=limit, digits=9)


@query("SELECT vec_id, len(embedding) BETWEEN 1 AND 2048 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def v1_valid_vectors(spark, d):
    return _vectors(spark, d).select("vec_id", V.valid(F.col("values")).alias("valid"))


@query("WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT label AS l, min_by(v, vec_id) AS first FROM e GROUP BY label) SELECT vec_id, round(list_cosine_similarity(v, first), 9) AS cosine FROM e JOIN c ON e.label = c.l")
def v2_cosines(spark, d):
    rows = _vectors(spark, d)
    first = rows.groupBy("label").agg(F.min_by("values", "vec_id").alias("first"))
    return rows.join(first, "label").select("vec_id", F.round(V.cosine(F.col("values"), F.col("first")), 9).alias("cosine"))


@query(f"WITH {COSINES} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10")
def v3_exact_neighbours(spark, d):
    return _near(spark, d).select("query_id", "vec_id", "score", "rank")


FUSED = f"""{COSINES}, lex AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS rank FROM cosines WHERE label = query_label),
lexical AS (SELECT * FROM lex WHERE rank <= 10), vector AS (SELECT * FROM near WHERE rank <= 10),
both_sides AS (SELECT query_id, vec_id, l.rank AS lexical_rank, v.rank AS vector_rank, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS s FROM lexical l FULL JOIN vector v USING (query_id, vec_id))"""


def v4_fused_exact(spark: SparkSession, d: str) -> DataFrame:
    """The other ranking goes by the distance of ids within a label."""
    all_ = table(spark, d, "embeddings").select("vec_id", "label").where("label is not null")
    # The ten nearest ids are among the ten before and the ten after.
    beside = F.collect_list("vec_id").over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(-10, 10))
    other = all_.withColumn("_near", beside).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.explode("_near").alias("vec_id"))
    other = other.withColumn("score", F.abs(F.col("vec_id") - F.col("query_id")))
    other = ranked(other, "query_id", "vec_id", 10)
    return vectors.fuse(other, _near(spark, d), ["query_id", "vec_id"], "vec_id")


@query(f"WITH {FUSED} SELECT query_id, vec_id, lexical_rank, vector_rank, round(s, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM both_sides")
def v4_fused(spark, d):
    return v4_fused_exact(spark, d).withColumn("score", F.round("score", 12))


@query("SELECT (SELECT count(*) FROM documents) AS eligible, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS indexed, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing")
def v5_vector_coverage(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return vectors.coverage(table(spark, d, "documents").select("doc_id"), have, ["doc_id"])


@query("SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings p WHERE p.vec_id = e.vec_id AND p.label = e.label AND p.vec_id % 3 <> 0)")
def j15_stale_pins(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return vectors.stale_pins(rows, rows.where("vec_id % 3 <> 0"), ["vec_id", "label"])


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0")
def i11_changed_vectors(spark, d):
    rows = _vectors(spark, d)
    new = rows.withColumn("values", F.when(F.col("vec_id") % 4 == 0, F.reverse("values")).otherwise(F.col("values")))
    return vectors.changed_vectors(new, rows, ["vec_id"]).select("vec_id")


# Retrieval metrics.

JUDGED = """judged AS (SELECT item_id AS query_id, doc_id, quality AS gain FROM benchmark JOIN labels ON doc_id % 7 = item_id % 7),
doc_best AS (SELECT query_id, doc_id, min(rank) AS best FROM cands GROUP BY ALL),
docs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS rank FROM doc_best)"""
METRICS = f"""{SCORES}, {JUDGED},
good AS (SELECT query_id, doc_id, CAST(gain AS DOUBLE) AS gain FROM judged WHERE gain > 0),
ideal AS (SELECT query_id, sum(gain / log2(place + 1) ORDER BY place) FILTER (place <= 10) AS ideal, count(*) AS n_good FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM good) GROUP BY query_id),
hits AS (SELECT query_id, sum(gain / log2(rank + 1) ORDER BY rank) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 100) AS n_found, min(rank) FILTER (rank <= 10) AS first FROM docs JOIN good USING (query_id, doc_id) GROUP BY query_id),
metrics AS (SELECT query_id, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS ndcg_10, round(coalesce(n_found / n_good, 0), 9) AS recall_100, round(coalesce(1.0::DOUBLE / first, 0), 9) AS mrr_10 FROM (SELECT DISTINCT query_id FROM judged) LEFT JOIN ideal USING (query_id) LEFT JOIN hits USING (query_id))"""


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("m"))
    return table(spark, d, "labels").withColumn("m", F.col("doc_id") % 7).join(items, "m").select("query_id", "doc_id", F.col("quality").alias("gain"))


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    segments = S.segments_of(table(spark, d, "documents"))
    return segments, S.search(segments, table(spark, d, "benchmark").selectExpr("item_id as query_id", "text"))


def _document_ranks(spark: SparkSession, d: str) -> DataFrame:
    segments, found = _search(spark, d)
    return ireval.document_ranks(S.candidates(segments, found))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    out = ireval.metrics(_document_ranks(spark, d), _judgments(spark, d))
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("ndcg_10", "recall_100", "mrr_10")])


@query(with_(f"{SCORES}, {JUDGED}", "SELECT * FROM docs"))
def a9_document_ranks(spark, d):
    return _document_ranks(spark, d)


@query(with_(f"{SCORES}, {JUDGED}", "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM docs WHERE query_id <> doc_id"))
def a14_without_self(spark, d):
    return ireval.without_self(_document_ranks(spark, d))


@query(with_(METRICS, "SELECT * FROM metrics"))
def a11_metrics(spark, d):
    return _metrics(spark, d)


@query(with_(METRICS, "SELECT count(*) AS n_queries, round(avg(ndcg_10), 7) AS ndcg_10, round(avg(recall_100), 7) AS recall_100, round(avg(mrr_10), 7) AS mrr_10 FROM metrics"))
def a15_macro_means(spark, d):
    out = ireval.macro(_metrics(spark, d), "ndcg_10", "recall_100", "mrr_10")
    return out.select("n_queries", *[F.round(c, 7).alias(c) for c in ("ndcg_10", "recall_100", "mrr_10")])


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1] AS p50, list_sort(list(l_extendedprice))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1] AS p90, list_sort(list(l_extendedprice))[CAST(floor(0.99 * (count(*) - 1)) AS INT) + 1] AS p99 FROM lineitem GROUP BY l_returnflag")
def a16_percentiles(spark, d):
    return ireval.percentiles(table(spark, d, "lineitem"), "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["l_returnflag"])


BUDGETS = (1024, 8192, 32768)


def _walk(budget: int) -> str:
    return f"""walk{budget}(query_id, rank, used, sel) AS (
  SELECT query_id, rank, CASE WHEN bytes <= {budget} THEN bytes ELSE 0 END, bytes <= {budget} FROM cands WHERE rank = 1
  UNION ALL
  SELECT c.query_id, c.rank, used + CASE WHEN used + bytes <= {budget} THEN bytes ELSE 0 END, used + bytes <= {budget} FROM walk{budget} w JOIN cands c ON c.query_id = w.query_id AND c.rank = w.rank + 1)"""


@query(
    with_(
        f"{SCORES}, {JUDGED}, {', '.join(map(_walk, BUDGETS))}, picked AS ({' UNION ALL '.join(f'SELECT {b} AS budget, query_id, doc_id, bytes FROM walk{b} JOIN cands USING (query_id, rank) WHERE sel' for b in BUDGETS)}),\n"
        "j AS (SELECT DISTINCT query_id, doc_id FROM judged), n AS (SELECT query_id, count(*) AS n_judged FROM j GROUP BY ALL), sums AS (SELECT budget, query_id, count(*) AS n_selected, sum(bytes) AS used FROM picked GROUP BY ALL),\n"
        "hit AS (SELECT budget, query_id, count(DISTINCT doc_id) AS n_hit FROM picked JOIN j USING (query_id, doc_id) GROUP BY ALL),\n"
        f"per AS (SELECT v.budget, n.query_id, coalesce(n_hit, 0) / n_judged AS coverage, coalesce(n_selected, 0) AS n_selected, coalesce(used, 0) AS used FROM n CROSS JOIN (VALUES {', '.join(f'({b})' for b in BUDGETS)}) v(budget) LEFT JOIN sums s ON s.budget = v.budget AND s.query_id = n.query_id LEFT JOIN hit h ON h.budget = v.budget AND h.query_id = n.query_id)",
        "SELECT budget, count(*) AS n_queries, round(avg(coverage), 9) AS coverage, CAST(sum(n_selected) // count(*) AS BIGINT) AS selected, CAST(sum(used) // count(*) AS BIGINT) AS used, round((sum(used) // count(*)) / budget, 9) AS utilisation FROM per GROUP BY budget",
    )
)
def a19_coverage_curve(spark, d):
    segments, found = _search(spark, d)
    about = Scratch(spark, "curve").stored(S.candidates(segments, found), "candidates")
    judged = _judgments(spark, d)
    runs = None
    for b in BUDGETS:
        one = S.packed(about, b).withColumn("budget", F.lit(b))
        runs = one if runs is None else runs.unionByName(one)
    cover = ireval.coverage(runs.where("selected"), judged, ["budget"])
    sums = runs.groupBy("budget", "query_id").agg(F.count_if("selected").alias("n_selected"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("bytes"))), F.lit(0)).alias("used_bytes"))
    per = cover.join(sums, ["budget", "query_id"], "left").na.fill(0, ["n_selected", "used_bytes"])
    out = ireval.coverage_curve(per)
    return out.select("budget", "n_queries", F.round("coverage", 9).alias("coverage"), "selected", "used", F.round("utilisation", 9).alias("utilisation"))


# The second run lacks the first document of each.
COMPARED = f"""{METRICS}, a AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS ranked FROM docs GROUP BY ALL), b AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS ranked FROM docs WHERE rank > 1 GROUP BY ALL),
met AS (SELECT query_id, rank FROM docs JOIN good USING (query_id, doc_id)),
firsts AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10), 0) AS mrr_a, coalesce(1.0::DOUBLE / min(rank - 1) FILTER (rank BETWEEN 2 AND 11), 0) AS mrr_b FROM (SELECT DISTINCT query_id FROM judged) LEFT JOIN met USING (query_id) GROUP BY query_id)"""


@query(
    with_(
        COMPARED,
        """SELECT count(*) AS n_queries, count(*) FILTER (a.ranked IS NOT DISTINCT FROM b.ranked) AS n_identical, min(query_id) FILTER (a.ranked IS DISTINCT FROM b.ranked) AS first_difference,
  round(coalesce(avg(mrr_b) FILTER (b.ranked IS NOT NULL), 0) - coalesce(avg(mrr_a) FILTER (a.ranked IS NOT NULL), 0), 9) AS delta_mrr_10 FROM a FULL JOIN b USING (query_id) LEFT JOIN firsts USING (query_id)""",
    )
)
def a21_compare_runs(spark, d):
    docs, judged = _document_ranks(spark, d), _judgments(spark, d)

    def report(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",").alias("ranked"))
        return listed.join(ireval.metrics(rows, judged).select("query_id", "mrr_10"), "query_id", "left")

    out = ireval.compare(report(docs), report(docs.where("rank > 1").withColumn("rank", F.col("rank") - 1)), ["mrr_10"])
    return out.withColumn("delta_mrr_10", F.round("delta_mrr_10", 9))


@query(with_(f"{SCORES}, {JUDGED}", "SELECT query_id, count(*) AS n_ranked, count(DISTINCT doc_id) AS n_distinct FROM cands GROUP BY query_id HAVING count(*) <> count(DISTINCT doc_id)"))
def q8_invalid_rankings(spark, d):
    segments, found = _search(spark, d)
    return ireval.invalid_rankings(S.candidates(segments, found))


@query("SELECT axis, n_values FROM (SELECT 'lang' AS axis, count(DISTINCT lang) AS n_values FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents) WHERE n_values > 1")
def q6_comparability(spark, d):
    docs = table(spark, d, "documents").withColumn("mode", F.lit("lexical"))
    return ireval.comparable(docs, ["lang", "source", "mode"])


@query(
    """WITH p AS (SELECT event_type AS phase, value, event_id % 50 = 0 AS bad, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT phase, count(*) AS n, max(value) FILTER (place = least(floor(0.5 * n), n - 1)) AS p50, max(value) FILTER (place = least(floor(0.99 * n), n - 1)) AS p99, max(value) AS most, count(*) FILTER (bad) AS n_errors FROM p GROUP BY phase"""
)
def a26_phase_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("phase"), "value", F.when(F.col("event_id") % 50 == 0, "busy").alias("error"))
    return ireval.phase_summary(rows, "phase", "value", "error")


# Questions: a conversation asks, its answers are byte ranges of documents.

ASKED_SQL = """answers AS (SELECT item_id AS question, item_id % 3 AS passage_group, item_id AS passage, doc_id, CAST(item_id * 13 % 900 AS BIGINT) AS start, CAST(item_id * 13 % 900 + 700 AS BIGINT) AS stop FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
results AS (SELECT item_id AS question, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS BIGINT) AS rank, CAST(k * 512 AS BIGINT) AS start, CAST(k * 512 + 600 AS BIGINT) AS stop FROM benchmark JOIN documents ON doc_id % 20 = item_id % 20 CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE (doc_id + k) % 4 <> 0)"""


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items, docs = table(spark, d, "benchmark").select("item_id"), table(spark, d, "documents").select("doc_id")
    hit = items.withColumn("m", F.col("item_id") % 40).join(docs.withColumn("m", F.col("doc_id") % 40), "m")
    answers = hit.selectExpr("item_id as question", "item_id % 3 as passage_group", "doc_id as passage", "cast(doc_id as string) as source", "item_id * 13 % 900 as start", "item_id * 13 % 900 + 700 as stop", "cast(null as string) as anchor")
    near = items.withColumn("m", F.col("item_id") % 20).join(docs.withColumn("m", F.col("doc_id") % 20), "m").withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).where("(doc_id + k) % 4 <> 0")
    results = near.selectExpr("item_id as question", "cast(doc_id as string) as source", "doc_id", "k", "k * 512 as start", "k * 512 + 600 as stop", "'' as text")
    return results, answers


@query(f"WITH {ASKED_SQL} SELECT a.question, a.passage_group, a.doc_id AS passage, count(*) AS n_hits FROM results r JOIN answers a USING (question, doc_id) WHERE r.start < a.stop AND a.start < r.stop GROUP BY ALL")
def j19_overlaps(spark, d):
    results, answers = _questions(spark, d)
    return questions.overlaps(results.withColumn("rank", F.lit(1)), answers).groupBy("question", "passage_group", "passage").agg(F.count("*").alias("n_hits"))


@query(
    f"""WITH {ASKED_SQL}, near AS (SELECT a.question, a.doc_id, a.start, a.stop, r.start AS rs, r.stop AS re FROM results r JOIN answers a USING (question, doc_id)),
reached AS (SELECT *, greatest(start, coalesce(max(re) OVER (PARTITION BY question, doc_id ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS reach FROM near WHERE rs <= stop AND start <= re),
done AS (SELECT question, doc_id, NOT bool_or(rs > reach AND reach < stop) AND max(re) >= max(stop) AS covered FROM reached GROUP BY ALL)
SELECT question, doc_id AS passage, coalesce(covered, false) AS covered FROM answers LEFT JOIN done USING (question, doc_id)"""
)
def j21_covers(spark, d):
    results, answers = _questions(spark, d)
    return questions.covers(results, answers)


SCORED_SQL = f"""{ASKED_SQL}, ranked_results AS (SELECT question, doc_id, start, stop, row_number() OVER (PARTITION BY question ORDER BY doc_id, start) AS rank FROM (SELECT question, doc_id, start, stop FROM results)),
best AS (SELECT a.question, a.passage_group, min(r.rank) AS rank FROM ranked_results r JOIN answers a USING (question, doc_id) WHERE r.start < a.stop AND a.start < r.stop GROUP BY ALL),
groups AS (SELECT DISTINCT question, passage_group FROM answers),
per AS (SELECT question, count(*) AS n_groups, count(rank) AS groups_covered, max(rank) AS last FROM groups LEFT JOIN best USING (question, passage_group) GROUP BY ALL),
scored AS (SELECT item_id AS question, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus, coalesce(groups_covered, 0) AS groups_covered, coalesce(n_groups, 0) AS n_groups, coalesce(groups_covered = n_groups, false) AS answered, CASE WHEN groups_covered = n_groups THEN last END AS rank FROM benchmark LEFT JOIN per ON question = item_id)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    results, answers = _questions(spark, d)
    results = ranked(results.withColumn("score", F.col("doc_id") * 10 + F.col("k")), "question", "source", None)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("corpus"))
    return questions.score(questions.overlaps(results, answers), asked, answers.select("question", "passage_group").distinct())


@query(f"WITH {SCORED_SQL} SELECT * FROM scored")
def a23_question_scores(spark, d):
    return _scored(spark, d)


@query(f"WITH {SCORED_SQL} SELECT corpus, count(*) AS n_questions, count(*) FILTER (answered) AS n_answered, round(sum(groups_covered) / sum(n_groups), 9) AS group_coverage, CAST(median(rank) AS DOUBLE) AS median_rank FROM scored GROUP BY ROLLUP (corpus)")
def a22_question_summary(spark, d):
    return questions.summary(_scored(spark, d)).withColumn("group_coverage", F.round("group_coverage", 9))


@query("SELECT item_id AS question, item_id % 3 AS kind, (row_number() OVER (PARTITION BY item_id % 3 ORDER BY sha256('split-1:' || CAST(item_id AS VARCHAR))) - 1) % 2 AS half FROM benchmark")
def a24_halves(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), (F.col("item_id") % 3).alias("kind"))
    return questions.halves(rows, "split-1:")



def _mean_sql(rows: str) -> str:
    return f"""(SELECT run, query_id, coalesce((sum(gain / log2(rank + 1) ORDER BY rank) FILTER (rank <= 10)) / nullif(any_value(ideal), 0), 0) AS ndcg, coalesce(count(gain) FILTER (rank <= 100) / nullif(any_value(n_good), 0), 0) AS recall,
  coalesce(1.0::DOUBLE / (min(rank) FILTER (rank <= 10 AND gain IS NOT NULL)), 0) AS mrr
  FROM (SELECT DISTINCT run, query_id FROM runs JOIN (SELECT DISTINCT query_id FROM judged) USING (query_id)) LEFT JOIN ideal USING (query_id) LEFT JOIN (SELECT * FROM {rows} JOIN good USING (query_id, doc_id)) USING (run, query_id) GROUP BY ALL)"""


# Two saved runs: the ranking itself, and the one without its first documents. Numbers of some documents are those of queries, too.
@query(
    with_(
        METRICS,
        f""", runs AS (SELECT 1 AS run, query_id, doc_id, rank FROM docs UNION ALL SELECT 2, query_id, doc_id, rank - 1 FROM docs WHERE rank > 1),
others AS (SELECT run, query_id, doc_id, row_number() OVER (PARTITION BY run, query_id ORDER BY rank) AS rank FROM runs WHERE doc_id <> query_id),
a AS {_mean_sql("others")}, b AS {_mean_sql("runs")}
SELECT run, count(*) AS n_queries, (SELECT count(*) FROM runs r WHERE r.run = a.run AND doc_id = query_id) AS n_self_removed, round(avg(a.ndcg), 9) AS ndcg_10, round(avg(a.recall), 9) AS recall_100, round(avg(a.mrr), 9) AS mrr_10, round(avg(a.ndcg), 9) AS binary_ndcg_10,
  round(avg(b.ndcg), 9) AS ndcg_10_with_self FROM a JOIN b USING (run, query_id) GROUP BY run""",
    ).replace("\n,", ",", 1)
)
def a27_rescored_runs(spark, d):
    docs = _document_ranks(spark, d)
    runs = docs.withColumn("run", F.lit(1)).unionByName(docs.where("rank > 1").withColumn("run", F.lit(2)))
    saved = runs.groupBy("run", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias("ranked"))
    out = ireval.rescored(saved, _judgments(spark, d))
    return out.select("run", "n_queries", "n_self_removed", *[F.round(c, 9).alias(c) for c in ("ndcg_10", "recall_100", "mrr_10", "binary_ndcg_10", "ndcg_10_with_self")])
