"""Queries on ancestry, sources, sinks and whole-store checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import audit, corpus, lexical, lifecycle, lineage, trails
from ..sources import directory, jsonl
from . import search as S
from .sql import INDEX, ITEMS, SEGMENTS, with_

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Region, nation, customer, order as a chain of derivations.
EDGES_SQL = """edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, ka, b, kb: table(spark, d, t).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("child"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("parent"))
    return pair("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(pair("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(pair("orders", "o", "o_orderkey", "c", "o_custkey"))


@query(f"WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, child FROM reach JOIN edges ON parent = node) SELECT root, node FROM reach")
def j3_descendants(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return lineage.descendants(roots, _edges(spark, d))


# Lines derive from an order and a supplier, which may lead to one region by two ways or to two regions.
_SHARED_SQL = f"""{EDGES_SQL}, more AS (
  SELECT child, parent FROM edges UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey FROM lineitem
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 's' || l_suppkey FROM lineitem)"""


def _shared(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(_id("s", "s_suppkey").alias("child"), _id("n", "s_nationkey").alias("parent"))
    lines = table(spark, d, "lineitem").withColumn("child", F.concat(_id("l", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")))
    of = lines.select("child", F.explode(F.array(_id("o", "l_orderkey"), _id("s", "l_suppkey"))).alias("parent"))
    return _edges(spark, d).unionByName(suppliers).unionByName(of)


@query(f"WITH RECURSIVE {_SHARED_SQL}, reach AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, child FROM reach JOIN more ON parent = node) SELECT root, node FROM reach")
def u1_shared_ancestors(spark, d):
    return lineage.descendants(table(spark, d, "region").select(_id("r", "r_regionkey").alias("root")), _shared(spark, d))


@query(
    f"""WITH RECURSIVE {_SHARED_SQL}, lines AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS leaf FROM lineitem),
reach AS (SELECT leaf, leaf AS node FROM lines UNION SELECT leaf, parent FROM reach JOIN more ON child = node),
tops AS (SELECT leaf, count(*) AS n, min(node) AS origin FROM reach WHERE node NOT IN (SELECT child FROM more) GROUP BY leaf)
SELECT leaf, CASE WHEN n = 1 THEN origin END AS origin, CASE WHEN n > 1 THEN 'integrity' END AS problem FROM tops"""
)
def j6_two_ways_up(spark, d):
    leaves = table(spark, d, "lineitem").select(F.concat(_id("l", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("leaf"))
    return lineage.single_origin(leaves, lineage.origins(leaves, _shared(spark, d)))


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(_id("o", "o_orderkey").alias("leaf"))


@query("SELECT 'o' || o_orderkey AS leaf, 'o' || o_orderkey || '>c' || o_custkey || '>n' || c_nationkey || '>r' || n_regionkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j4_evidence_paths(spark, d):
    return lineage.evidence_paths(_leaves(spark, d), _edges(spark, d)).select("leaf", F.array_join("path", ">").alias("path"))


@query("SELECT 'o' || o_orderkey AS leaf, 'r' || n_regionkey AS origin, NULL AS problem FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j6_single_origin(spark, d):
    leaves = _leaves(spark, d)
    return lineage.single_origin(leaves, lineage.origins(leaves, _edges(spark, d)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def j10_orphans(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return audit.orphans(lines, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


# Keys are planted on either side: customers without orders of every tenth, orders of customers that don't exist.
@query(
    """WITH l AS (SELECT DISTINCT c_custkey AS key FROM customer), r AS (SELECT DISTINCT CASE WHEN o_custkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS key FROM orders)
SELECT key, 'left' AS side FROM l WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT key, 'right' FROM r WHERE key NOT IN (SELECT key FROM l)"""
)
def j8_unmatched_both_ways(spark, d):
    moved = F.when(F.col("o_custkey") % 10 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return audit.unmatched(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(moved.alias("key")), ["key"])


@query("SELECT o_custkey, count(*) AS n_segments, count(*) FILTER (o_orderstatus <> 'P') AS n_indexed FROM orders GROUP BY o_custkey HAVING count(*) <> count(*) FILTER (o_orderstatus <> 'P')")
def j9_incomplete_index(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderkey", "segment_id")
    return audit.incomplete_index(rows, rows.where("o_orderstatus <> 'P'"), "o_custkey")


@query("SELECT * FROM (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS \"left\", (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS \"right\" UNION ALL SELECT 'customers', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)) WHERE \"left\" <> \"right\"")
def a25_count_mismatches(spark, d):
    customers = table(spark, d, "customer")
    return audit.count_mismatches({"orders": (table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey").distinct()), "customers": (customers, customers)})


@query("SELECT l_orderkey, l_linenumber, before FROM (SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS before FROM lineitem) WHERE l_linenumber <> before + 1")
def w11_rank_violations(spark, d):
    return audit.consecutive_rank_violations(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "before")


@query(with_(SEGMENTS, "SELECT segment_id, side FROM (SELECT segment_id, 'derived' AS side FROM segs WHERE ordinal = 1)"))
def q7_derived_differently(spark, d):
    derived = S.segments_of(table(spark, d, "documents")).select("segment_id", "ordinal", "content_sha256")
    return audit.derived_differently(derived.where("ordinal <> 1"), derived).select("segment_id", "side")


# Planted: ends of segments, lines of orders that are open, items that come again, access times, digests of texts.
@query(
    with_(
        SEGMENTS,
        """, n AS (SELECT 'coordinates' AS "check", count(*) FILTER (doc_id % 7 = 0) AS n_rows FROM segs
UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'twice_identified', count(*) FILTER (doc_id % 9 = 0) FROM items
UNION ALL SELECT 'digests', count(*) FILTER (doc_id % 5 = 0) FROM items
UNION ALL SELECT 'segments', count(*) FILTER (ordinal = 1) FROM segs
UNION ALL SELECT 'log', (SELECT count(*) FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events WHERE event_id % 10 <> 3) WHERE event_id <> coalesce(before, -1) + 1))
SELECT * FROM n""",
    ).replace("\n,", ",", 1)
)
def q1_audit(spark, d):
    documents = table(spark, d, "documents")
    items = corpus.items(documents)
    segments = corpus.fixed_segments(items)
    moved = segments.withColumn("stop", F.when(F.col("doc_id") % 7 == 0, F.col("stop") + 1).otherwise(F.col("stop")))
    kept = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    named = items.select("doc_id", "observation_id")
    told = items.withColumn("content_sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("content_sha256")))
    log = table(spark, d, "events").where("event_id % 10 <> 3").select((F.col("event_id") + 1).alias("seq"))
    derived = segments.select("segment_id", "ordinal")
    return audit.violations(
        {
            "coordinates": moved.where(~corpus.coordinates_hold(moved)),
            "orphan_lines": audit.orphans(table(spark, d, "lineitem").select("l_orderkey"), kept, ["l_orderkey"]),
            "twice_identified": named.unionByName(named.where("doc_id % 9 = 0")).groupBy("observation_id").count().where("count > 1"),
            "digests": told.where(I.content_digest(F.col("body")) != F.col("content_sha256")),
            "segments": audit.derived_differently(derived.where("ordinal <> 1").select("segment_id"), derived.select("segment_id")),
            "log": audit.sequence_gaps(log),
        }
    )


@query("SELECT source, count(*) AS n_observations, count(DISTINCT doc_id) AS n_items FROM documents GROUP BY source")
def a4_item_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_observations"), F.countDistinct("doc_id").alias("n_items"))


@query("SELECT doc_id, source FROM documents WHERE doc_id = 17")
def src12_point_lookup(spark, d):
    return table(spark, d, "documents").where("doc_id = 17").select("doc_id", "source")


@query(with_(SEGMENTS, "SELECT segment_id FROM segs WHERE doc_id % 3 <> 0"))
def snk3_without_index(spark, d):
    segments = S.segments_of(table(spark, d, "documents")).select("segment_id", "representation_id", "doc_id")
    dropped = segments.where("doc_id % 3 = 0").select("representation_id").distinct()
    return lifecycle.without_index(segments, dropped.join(segments.where("doc_id % 3 <> 0"), "representation_id", "left_anti")).select("segment_id")


@query("SELECT DISTINCT l_orderkey AS trail_id FROM lineitem WHERE l_suppkey % 5 = 0")
def j11_trails_of_source(spark, d):
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "trail_id", "l_partkey": "segment_id", "l_suppkey": "supplier"})
    rows = lines.select("trail_id", F.concat_ws("/", "segment_id", "supplier").alias("segment_id"))
    segments = lines.select(F.concat_ws("/", "segment_id", "supplier").alias("segment_id"), "supplier").distinct()
    return trails.of_source(lines.select("trail_id").distinct(), rows, segments, F.col("supplier") % 5 == 0)


@query("SELECT l_orderkey AS trail_id, l_linenumber AS position, l_partkey AS segment_id, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS indexed_now FROM lineitem")
def j12_indexed_now(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as trail_id", "l_linenumber as position", "l_partkey as segment_id")
    return trails.indexed_now(rows, table(spark, d, "part").where("p_size > 25").selectExpr("p_partkey as segment_id"))


@query("SELECT l_orderkey AS trail_id, count(*) FILTER (l_returnflag <> 'R') AS n_shown, count(*) FILTER (l_returnflag = 'R') AS n_rejected FROM lineitem GROUP BY l_orderkey")
def p20_trail_view(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trail_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("disposition"))
    seen = trails.gathered(rows).select("trail_id", trails.view(F.col("candidates")).alias("v"))
    return seen.select("trail_id", F.size("v.candidates").cast("long").alias("n_shown"), F.col("v.n_rejected").alias("n_rejected"))


def _paths_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "").alias("path"))


@query("SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)\\.git(/|$)') THEN 'git_metadata' WHEN regexp_matches(path, '(^|/)1[^/]*$') THEN 'explicit_exclude' WHEN regexp_matches(path, '(^|/)\\.') THEN 'hidden' WHEN regexp_matches('/' || path, '/(node_modules|vendor|target|dist|build|__pycache__)/') THEN 'generated_directory' WHEN NOT regexp_matches(path, '^[^/]*/[0-9][^/]*$') THEN 'not_included' END AS reason FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path FROM pages)")
def src2_exclusion(spark, d):
    return _paths_of(spark, d).select("page_id", directory.exclusion(F.col("path"), include=("*/[0-9]*",), exclude=("1*",)).alias("reason"))


JSONL_SQL = """lines AS (SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, role, text) AS BIGINT) AS line_no, conv_id, turn FROM conversations)"""


@query(f"WITH {JSONL_SQL}, firsts AS (SELECT line_no, conv_id // 2 AS item, min(line_no) OVER (PARTITION BY conv_id // 2) AS f FROM lines WHERE turn % 4 <> 3) SELECT line_no, CASE WHEN turn % 4 = 3 THEN 'bad' WHEN line_no > f THEN 'repeat' ELSE 'good' END AS verdict FROM lines LEFT JOIN firsts USING (line_no)")
def src7_strict_items(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "conversations").withColumn("line_no", F.row_number().over(Window.orderBy("conv_id", "turn", "role", "text")).cast("long"))
    good = F.to_json(F.struct(F.floor(F.col("conv_id") / 2).cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    lines = rows.select("line_no", F.when(F.col("turn") % 4 == 3, F.lit('{"id": "a", "id": "b", "text": ""}')).otherwise(good).alias("value"))
    got = jsonl.decode_lines(lines)
    verdict = F.when(F.col("item").isNull(), "bad").when(F.col("problem").isNotNull(), "repeat").otherwise("good")
    return got.select("line_no", verdict.alias("verdict"))


@query("SELECT item_id % 5 AS query_id, CAST(d.doc_id AS BIGINT) AS doc_id, CAST(max_by(quality, item_id * 100000 + d.doc_id) AS INT) AS gain FROM benchmark JOIN labels d ON d.doc_id % 9 = item_id % 9 WHERE d.doc_id IN (SELECT doc_id FROM documents WHERE source <> 'src0') GROUP BY ALL")
def src9_judgments(spark, d):
    pairs = table(spark, d, "labels").withColumn("m", F.col("doc_id") % 9).join(table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 9).alias("m")), "m")
    lines = pairs.select((F.col("item_id") * 100000 + F.col("doc_id") + 2).alias("line_no"), F.concat_ws("\t", (F.col("item_id") % 5).cast("string"), F.lit("0"), "doc_id", "quality").alias("value"))
    header = spark.createDataFrame([(1, "query-id\titeration\tcorpus-id\tscore")], "line_no long, value string")
    queries_ = table(spark, d, "benchmark").select((F.col("item_id") % 5).cast("string").alias("query_id")).distinct()
    docs = table(spark, d, "documents").where("source <> 'src0'").select(F.col("doc_id").cast("string").alias("doc_id"))
    got = jsonl.parse_judgments(lines.unionByName(header), queries_, docs)
    return got.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "gain")


@query(
    """WITH kept AS (SELECT doc_id FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 100), judged AS (SELECT doc_id % 7 AS query_id, doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM kept))
SELECT 'document' AS kind, CAST(NULL AS BIGINT) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(NULL AS BIGINT) AS gain FROM kept
UNION ALL SELECT 'judgment', query_id, CAST(doc_id AS VARCHAR), CAST(quality AS BIGINT) FROM judged UNION ALL SELECT DISTINCT 'query', query_id, NULL, CAST(NULL AS BIGINT) FROM judged WHERE quality > 0"""
)
def src10_limit_corpus(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    judged = table(spark, d, "labels").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("long").alias("gain"))
    kept = jsonl.limit_corpus(docs, judged, judged.select("query_id").distinct(), 100)
    shown = [df.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (("query_id", "long"), ("doc_id", "string"), ("gain", "long"))]) for kind, df in zip(("document", "judgment", "query"), kept, strict=True)]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("SELECT vec_id, 64 AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def src11_vector_import(spark, d):
    rows = table(spark, d, "embeddings")
    space = F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("1").alias("version"), F.lit(64).alias("dimensions"), F.lit("cosine").alias("metric"))
    one = F.struct(F.lit("s").alias("source_id"), F.col("vec_id").cast("string").alias("segment_id"), F.lit("r").alias("representation_id"), F.lit("c").alias("content_sha256"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    sent = rows.select(F.to_json(F.struct(space.alias("space"), F.array(one).alias("embeddings"))).alias("value"))
    got = jsonl.decode_vectors(sent)
    return got.select(F.col("segment_id").cast("long").alias("vec_id"), F.col("space.dimensions").alias("dimensions"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(with_(INDEX, "SELECT doc_id, segment_id, n_tokens FROM segs JOIN lens USING (segment_id)"))
def i9_current_passages(spark, d):
    """Active items meet their segments, and these the index."""
    segments = S.segments_of(table(spark, d, "documents"))
    return segments.join(lexical.lengths(segments), "segment_id").select("doc_id", "segment_id", "n_tokens")
