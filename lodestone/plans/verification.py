"""Queries that hold stored trails against records, with faults planted, and SQL that finds the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..operators import corpus, packing, vectors, verify
from . import evaluation
from .sql import EMPTY, SEGMENTS, with_

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# A trail for each conversation: its turns as candidates, equal roles as equal texts, so that there are duplicates and turns that don't fit.
# Planted: flags, budgets, ranks, omissions, references, ids, sums and outcomes, by remainders of conversation and turn.
BUDGET = 2 * 40 + 9


@query(
    f"""WITH RECURSIVE given AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, sha256(conv_id || '-' || turn) AS id, sha256(role) AS digest, CAST(40 + octet_length(encode(role)) AS BIGINT) AS bytes, conv_id % 2 = 0 AS exact,
    conv_id % 5 = 0 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 3 AS rejected FROM conversations),
accepted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS rank FROM given WHERE NOT rejected),
walk(conv_id, rank, used, sel, seen) AS (
  SELECT conv_id, rank, CASE WHEN bytes <= {BUDGET} THEN bytes ELSE 0 END, bytes <= {BUDGET}, CASE WHEN bytes <= {BUDGET} THEN [digest] ELSE [] END FROM accepted WHERE rank = 1
  UNION ALL
  SELECT a.conv_id, a.rank, used + CASE WHEN fits THEN bytes ELSE 0 END, fits, CASE WHEN fits THEN list_append(seen, digest) ELSE seen END
  FROM (SELECT a.*, w.used, w.seen, used + bytes <= {BUDGET} AND NOT (exact AND list_contains(seen, digest)) AS fits FROM walk w JOIN accepted a ON a.conv_id = w.conv_id AND a.rank = w.rank + 1) a),
chosen AS (SELECT a.*, sel, CASE WHEN exact AND NOT sel THEN CASE WHEN EXISTS (SELECT 1 FROM accepted b JOIN walk v ON v.conv_id = b.conv_id AND v.rank = b.rank WHERE b.conv_id = a.conv_id AND b.rank < a.rank AND b.digest = a.digest AND v.sel) THEN 'duplicate' ELSE 'budget' END END AS omission,
  (SELECT min(b.rank) FROM accepted b JOIN walk v ON v.conv_id = b.conv_id AND v.rank = b.rank WHERE b.conv_id = a.conv_id AND b.digest = a.digest AND v.sel) AS twin FROM accepted a JOIN walk w USING (conv_id, rank)),
marked AS (SELECT c.*, CASE WHEN omission = 'duplicate' THEN (SELECT id FROM accepted b WHERE b.conv_id = c.conv_id AND b.rank = c.twin) END AS dup FROM chosen c),
rows_ AS (
  SELECT conv_id, k, CASE WHEN conv_id % 29 = 3 AND k = 2 THEN (SELECT id FROM given h WHERE h.conv_id = marked.conv_id AND h.k = 1) ELSE id END AS id, digest, bytes, exact, true AS accepted,
    rank + CASE WHEN conv_id % 7 = 1 AND k = 2 THEN 1 ELSE 0 END AS rank, CASE WHEN conv_id % 11 = 2 AND k = 2 THEN NOT sel ELSE sel END AS sel,
    CASE WHEN conv_id % 13 = 4 AND k = 4 THEN 'budget' ELSE omission END AS omission, CASE WHEN conv_id % 17 = 5 THEN NULL ELSE dup END AS dup, false AS reasons FROM marked
  UNION ALL SELECT conv_id, k, id, digest, bytes, exact, false, NULL, false, CASE WHEN conv_id % 10 = 5 THEN 'budget' END, NULL, conv_id % 15 <> 0 FROM given WHERE rejected),
placed AS (SELECT *, coalesce(sum(CASE WHEN accepted AND sel THEN bytes END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, count(*) FILTER (accepted) OVER (PARTITION BY conv_id ORDER BY k) AS nth,
  row_number() OVER (PARTITION BY conv_id, id ORDER BY k) > 1 AS twice FROM rows_),
greedy(conv_id, nth, g_used, g_sel) AS (
  SELECT conv_id, nth, CASE WHEN bytes <= {BUDGET} THEN bytes ELSE 0 END, bytes <= {BUDGET} FROM placed WHERE accepted AND nth = 1
  UNION ALL SELECT p.conv_id, p.nth, g_used + CASE WHEN g_used + bytes <= {BUDGET} THEN bytes ELSE 0 END, g_used + bytes <= {BUDGET} FROM greedy g JOIN placed p ON p.conv_id = g.conv_id AND p.nth = g.nth + 1 WHERE p.accepted),
sums AS (SELECT conv_id, CAST(coalesce(sum(bytes) FILTER (accepted AND sel), 0) AS BIGINT) + CASE WHEN conv_id % 23 = 1 THEN 1 ELSE 0 END AS used FROM placed GROUP BY conv_id),
found AS (
  SELECT conv_id, k AS position, 'twice' AS fault FROM placed WHERE twice
  UNION ALL SELECT conv_id, k, 'rejected' FROM placed WHERE NOT accepted AND (omission IS NOT NULL OR NOT reasons)
  UNION ALL SELECT conv_id, k, 'rank' FROM placed WHERE accepted AND rank <> nth
  UNION ALL SELECT conv_id, k, 'selected' FROM placed WHERE accepted AND exact AND sel AND (omission IS NOT NULL OR dup IS NOT NULL OR bytes > {BUDGET} - used)
  UNION ALL SELECT conv_id, k, 'duplicate' FROM placed p WHERE accepted AND exact AND NOT sel AND omission = 'duplicate' AND NOT EXISTS (
    SELECT 1 FROM placed q WHERE q.conv_id = p.conv_id AND q.k < p.k AND q.id = p.dup AND NOT q.twice AND q.sel AND q.digest = p.digest AND q.bytes = p.bytes)
  UNION ALL SELECT conv_id, k, 'budget' FROM placed WHERE accepted AND exact AND NOT sel AND omission = 'budget' AND (dup IS NOT NULL OR bytes <= {BUDGET} - used)
  UNION ALL SELECT conv_id, k, 'omission' FROM placed WHERE (accepted AND exact AND NOT sel AND omission IS NULL) OR (NOT exact AND (omission IS NOT NULL OR dup IS NOT NULL))
  UNION ALL SELECT p.conv_id, p.rank, 'selected' FROM placed p JOIN greedy g ON g.conv_id = p.conv_id AND g.nth = p.nth WHERE p.accepted AND NOT exact AND sel <> g_sel
  UNION ALL SELECT conv_id, 0, 'used' FROM sums WHERE conv_id % 23 = 1
  UNION ALL SELECT conv_id, 0, 'packet' FROM sums WHERE conv_id % 31 = 2
  UNION ALL SELECT DISTINCT conv_id, 0, 'denied' FROM placed WHERE conv_id % 37 = 0)
SELECT conv_id, CAST(position AS BIGINT) AS position, fault FROM found"""
)
def k3_packing_faults(spark, d):
    conv, k = F.col("conv_id"), F.col("k")
    first = Window.partitionBy("conv_id").orderBy("turn")
    given = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("-", conv.cast("string"), F.col("turn").cast("string")), 256).alias("segment_id"), F.sha2("role", 256).alias("content_sha256"), (40 + F.octet_length("role")).cast("long").alias("bytes"))
    given = given.withColumn("k", F.row_number().over(first)).withColumn("_first", F.first("segment_id").over(first)).withColumn("rejected", (conv % 5 == 0) & (k == 3))
    rank = F.sum((~F.col("rejected")).cast("long")).over(Window.partitionBy("conv_id").orderBy("k"))
    given = given.withColumn("rank", F.when(~F.col("rejected"), rank))
    packed = packing.gathered(given.where("not rejected"), "conv_id", "k", "segment_id", "content_sha256", "bytes")
    flags = F.transform(packing.pack("candidates", BUDGET)["flags"], lambda f: F.struct(f.alias("selected"), F.lit(None).cast("string").alias("omission"), F.lit(None).cast("string").alias("duplicate_of")))
    marks = F.when(conv % 2 == 0, packing.pack_distinct(F.col("candidates"), BUDGET)["marks"]).otherwise(flags)
    marked = packed.select("conv_id", F.inline(F.arrays_zip(F.col("candidates.k").alias("k"), marks.alias("m")))).select("conv_id", "k", "m.*")
    rows = given.join(marked, ["conv_id", "k"], "left")
    at = lambda m, r, n: (conv % m == r) & (k == n)
    rows = rows.select(
        "conv_id", "k", "content_sha256", "bytes",
        F.when(at(29, 3, 2) & ~F.col("rejected"), F.col("_first")).otherwise(F.col("segment_id")).alias("segment_id"),
        (F.col("rank") + at(7, 1, 2).cast("long")).alias("rank"),
        F.when(F.col("rejected"), "rejected").otherwise("accepted").alias("disposition"),
        F.coalesce(F.when(at(11, 2, 2), ~F.col("selected")).otherwise(F.col("selected")), F.lit(False)).alias("selected"),
        F.when(F.col("rejected"), F.when(conv % 10 == 5, "budget")).when(at(13, 4, 4), "budget").otherwise(F.col("omission")).alias("omission"),
        F.when(conv % 17 != 5, F.col("duplicate_of")).alias("duplicate_of"),
        F.when(F.col("rejected") & (conv % 15 != 0), F.array(F.lit("stale"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    chosen = F.when((F.col("disposition") == "accepted") & F.col("selected"), F.struct("k", "rank", "segment_id", "content_sha256", "bytes"))
    trails = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "rank", "segment_id", "content_sha256", "bytes", "disposition", "selected", "omission", "duplicate_of", "reasons"))).alias("candidates"),
        F.sort_array(F.collect_list(chosen)).alias("s"),
        F.coalesce(F.sum(F.when(chosen.isNotNull(), F.col("bytes"))), F.lit(0)).alias("used"),
    )
    trails = trails.withColumn("budget", F.lit(BUDGET).cast("long")).withColumn("used", F.col("used") + (conv % 23 == 1).cast("long"))
    trails = trails.withColumn("packet_id", F.when(conv % 31 == 2, F.sha2(F.lit("other"), 256)).otherwise(I.packet_id(F.col("budget"), F.col("used"), F.col("s"))))
    trails = trails.withColumn("policy", F.when(conv % 2 == 0, verify.EXACT).otherwise(verify.ORIGINAL)).withColumn("outcome", F.when(conv % 37 == 0, "policy_excluded").otherwise("evidence"))
    return verify.packing_faults(trails, "conv_id")


# Segments dealt into trails by their digests, so that equal texts meet; a trail is decided for the source of its first one. Planted by position.
@query(
    with_(
        SEGMENTS,
        f""", dealt AS (SELECT segment_id AS id, source_id, content_sha256 AS digest, stop - start AS size, text, CAST(('0x' || substr(content_sha256, 1, 6)) AS BIGINT) % ((SELECT count(*) FROM segs) // 64 + 1) AS trail_id FROM segs),
placed AS (SELECT *, row_number() OVER t AS p, first_value(source_id) OVER t AS decided, row_number() OVER (PARTITION BY trail_id, digest ORDER BY id) = 1 AS sel, first_value(id) OVER (PARTITION BY trail_id, digest ORDER BY id) AS twin FROM dealt WINDOW t AS (PARTITION BY trail_id ORDER BY id)),
stored AS (SELECT *, CASE WHEN p % 17 = 5 THEN sha256(id) ELSE id END AS rid, CASE WHEN p % 11 = 3 THEN '{EMPTY}' ELSE digest END AS rdigest, size + CASE WHEN p % 13 = 4 THEN 1 ELSE 0 END AS rsize,
  CASE WHEN p % 23 = 7 THEN NULL WHEN p % 19 = 6 THEN text || '!' ELSE text END AS kept, CASE WHEN NOT sel AND p % 3 <> 0 THEN twin END AS dup FROM placed),
held AS (SELECT *, p % 17 <> 5 AS known, CASE WHEN p % 17 <> 5 THEN kept END AS t2 FROM stored),
looked AS (SELECT *, first_value(CASE WHEN sel AND t2 IS NOT NULL THEN rid END IGNORE NULLS) OVER (PARTITION BY trail_id, rdigest, t2 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM held)
SELECT trail_id, p AS position, 'missing' AS fault FROM looked WHERE NOT known
UNION ALL SELECT trail_id, p, 'digest' FROM looked WHERE known AND rdigest <> digest
UNION ALL SELECT trail_id, p, 'size' FROM looked WHERE known AND rsize <> size
UNION ALL SELECT trail_id, p, 'ancestry' FROM looked WHERE known AND source_id <> decided
UNION ALL SELECT trail_id, p, 'text' FROM looked WHERE known AND t2 IS NOT NULL AND p % 19 = 6
UNION ALL SELECT trail_id, p, 'duplicate' FROM looked WHERE t2 IS NOT NULL AND dup IS DISTINCT FROM before""",
    ).replace("\n,", ",", 1)
)
def q3_content_faults(spark, d):
    items = corpus.items(table(spark, d, "documents"))
    segments = corpus.fixed_segments(items)
    n = segments.agg((F.count("*") - F.count("*") % 64) / 64 + 1).first()[0]
    trail = F.conv(F.substring("content_sha256", 1, 6), 16, 10).cast("long") % int(n)
    by, same = Window.partitionBy("trail_id").orderBy("segment_id"), Window.partitionBy("trail_id", "content_sha256").orderBy("segment_id")
    placed = segments.withColumn("trail_id", trail).withColumn("position", F.row_number().over(by).cast("long")).withColumn("source", F.first("source_id").over(by))
    placed = placed.withColumn("selected", F.row_number().over(same) == 1).withColumn("_twin", F.first("segment_id").over(same))
    p = F.col("position")
    text = F.when(p % 23 != 7, F.when(p % 19 == 6, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    rows = placed.select(
        "trail_id", "position", "source", F.lit(True).alias("exact"), F.lit("accepted").alias("disposition"), "selected",
        F.when(p % 17 == 5, F.sha2("segment_id", 256)).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(p % 11 == 3, F.lit(EMPTY)).otherwise(F.col("content_sha256")).alias("content_sha256"),
        (F.col("stop") - F.col("start") + (p % 13 == 4).cast("long")).alias("bytes"),
        F.when(~F.col("selected") & (p % 3 != 0), F.col("_twin")).alias("duplicate_of"),
    )
    chain = ("representation_id", "artifact_id", "observation_id", "source_id")
    edges = items.select(F.explode(F.array(*[F.struct(F.col(a).alias("child"), F.col(b).alias("parent")) for a, b in zip(chain, chain[1:], strict=False)])).alias("e")).select("e.*")
    return verify.content_faults(rows, placed.withColumn("text", text), edges)


# The nearest vectors of every twentieth; cosines come from products of blocks and are made again one by one. Planted: cosines, labels, vectors that are gone.
@query(
    f"""WITH {evaluation.COSINES}, top AS (SELECT * FROM near WHERE rank <= 10)
SELECT query_id, CAST(rank AS BIGINT) AS position, 'missing' AS fault FROM top WHERE vec_id % 13 = 0
UNION ALL SELECT query_id, rank, 'pins' FROM top WHERE vec_id % 13 <> 0 AND vec_id % 11 = 0
UNION ALL SELECT query_id, rank, 'cosine' FROM top WHERE vec_id % 13 <> 0 AND vec_id % 7 = 0"""
)
def q4_vector_faults(spark, d):
    all_ = evaluation._vectors(spark, d)
    asked = all_.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "values")
    exact = vectors.exact_neighbours(all_, asked, limit=10, digits=9, raw=True)
    rows = exact.select("query_id", "vec_id", F.col("score").alias("cosine"), F.col("rank").alias("position")).join(all_.select("vec_id", "label"), "vec_id")
    rows = rows.withColumn("cosine", F.when(F.col("vec_id") % 7 == 0, F.col("cosine") + 1e-13).otherwise(F.col("cosine"))).withColumn("label", F.when(F.col("vec_id") % 11 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return verify.cosine_faults(rows, asked, all_.where("vec_id % 13 <> 0"), ["vec_id"], ["label"], "query_id")


@query(
    f"""WITH {evaluation.FUSED}, placed AS (SELECT query_id, vec_id, lexical_rank, vector_rank, s, vec_id % 9 = 0 AS other,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) + CASE WHEN query_id % 40 = 0 THEN 1 ELSE 0 END AS position FROM both_sides),
planted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN other THEN s + 1e-16 * 32 ELSE s END DESC, vec_id) AS place FROM placed)
SELECT query_id, position, 'fused' AS fault FROM planted WHERE other OR (query_id % 60 = 20 AND vector_rank = 2)
UNION ALL SELECT query_id, position, 'order' FROM planted WHERE position <> place
UNION ALL SELECT query_id, position, 'rank_twice' FROM planted WHERE query_id % 60 = 20 AND vector_rank IN (1, 2)"""
)
def q4_fusion_faults(spark, d):
    rows = evaluation.v4_fused_exact(spark, d).withColumn("position", F.col("rank") + (F.col("query_id") % 40 == 0).cast("long"))
    rows = rows.withColumn("score", F.when(F.col("vec_id") % 9 == 0, F.col("score") + 1e-16 * 32).otherwise(F.col("score")))
    rows = rows.withColumn("vector_rank", F.when((F.col("query_id") % 60 == 20) & (F.col("vector_rank") == 2), 1).otherwise(F.col("vector_rank")))
    return verify.fusion_faults(rows, "vec_id", "query_id")
