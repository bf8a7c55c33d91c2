"""Queries on access, policy, item state, ingest and the log. Events stand for access and push events, conversations for item revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit, lifecycle, policy
from ..streaming import ingest

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Of the events: purchases deny, logins withdraw, the others allow.
ACCESS_SQL = "access_events AS (SELECT user_id AS source_id, event_id AS seq, epoch_us(ts) AS time, CASE WHEN event_id % 5 = 0 THEN 'deny' ELSE 'allow' END AS access FROM events)"


def _access(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.when(F.col("event_id") % 5 == 0, "deny").otherwise("allow").alias("access")
    )


@query(f"WITH {ACCESS_SQL} SELECT source_id, max_by(access, seq) AS access, max(seq) AS seq FROM access_events GROUP BY source_id")
def a3_current_access(spark, d):
    return policy.current_access(_access(spark, d))


# Every seventh event's clock is planted to be a year behind.
@query(f"WITH {ACCESS_SQL}, late AS (SELECT source_id, seq, CASE WHEN seq % 7 = 0 THEN time - 31536000000000 ELSE time END AS time FROM access_events) SELECT source_id, seq, time, before FROM (SELECT *, lag(time) OVER (PARTITION BY source_id ORDER BY seq) AS before FROM late) WHERE time <= before")
def w8_time_violations(spark, d):
    late = F.when(F.col("seq") % 7 == 0, F.col("time") - 31536000000000).otherwise(F.col("time"))
    return policy.time_violations(_access(spark, d).withColumn("time", late)).select("source_id", "seq", "time", "before")


@query(f"WITH {ACCESS_SQL} SELECT source_id, seq, greatest(time, coalesce(lag(time) OVER (PARTITION BY source_id ORDER BY seq) + 1, time)) AS next_time FROM access_events")
def w9_next_time(spark, d):
    last = F.lag("time").over(Window.partitionBy("source_id").orderBy("seq"))
    return _access(spark, d).select("source_id", "seq", policy.next_time(F.col("time"), last).alias("next_time"))


@query(
    f"""WITH {ACCESS_SQL}, now AS (SELECT source_id, max_by(access, seq) AS a FROM access_events WHERE seq % 3 <> 0 GROUP BY ALL),
wanted AS (SELECT DISTINCT c_custkey AS source_id, CASE WHEN c_custkey % 2 = 0 THEN 'deny' ELSE 'allow' END AS access, c_custkey % 3 = 0 AS only_if_unset FROM customer)
SELECT source_id, access, only_if_unset FROM wanted LEFT JOIN now USING (source_id) WHERE a IS NULL OR (NOT only_if_unset AND a <> access)"""
)
def i10_access_changes(spark, d):
    now = policy.current_access(_access(spark, d).where("seq % 3 <> 0"))
    wanted = table(spark, d, "customer").selectExpr("c_custkey as source_id", "if(c_custkey % 2 = 0, 'deny', 'allow') as access", "c_custkey % 3 = 0 as only_if_unset").distinct()
    return policy.appended(wanted, now)


POLICY_SQL = f"""{ACCESS_SQL}, access AS (SELECT source_id, max_by(access, seq) AS access FROM access_events WHERE seq % 2 = 0 GROUP BY ALL),
sources AS (SELECT c_custkey AS source_id FROM customer),
states AS (SELECT c_custkey AS source_id, CASE WHEN c_acctbal < 0 THEN 'withdrawn' ELSE 'active' END AS state FROM customer WHERE c_custkey % 7 <> 0),
decided AS (SELECT source_id, list_filter([CASE WHEN state IS NULL THEN 'missing_state' END, CASE WHEN state = 'withdrawn' THEN 'withdrawn' END,
  CASE WHEN access IS NULL THEN 'access_default' WHEN access = 'deny' THEN 'access_denied' END], lambda r: r IS NOT NULL) AS reasons
  FROM sources LEFT JOIN states USING (source_id) LEFT JOIN access USING (source_id))"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "source_id")
    states = customers.where("source_id % 7 <> 0").select("source_id", F.when(F.col("c_acctbal") < 0, "withdrawn").otherwise("active").alias("state"))
    return policy.outcomes(customers.select("source_id"), states, policy.current_access(_access(spark, d).where("seq % 2 = 0")))


@query(f"WITH {POLICY_SQL} SELECT source_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'allow' ELSE 'deny' END AS outcome FROM decided")
def p14_policy_outcomes(spark, d):
    return _decided(spark, d).select("source_id", F.array_join("reasons", ",").alias("reasons"), "outcome")


@query(
    f"""WITH {POLICY_SQL}, states2 AS (SELECT * FROM states),
seen AS (SELECT o_orderkey AS segment_id, o_custkey AS source_id, o_orderpriority AS text FROM orders),
flags AS (SELECT segment_id, text, bool_or(coalesce(state = 'withdrawn', false)) AS w, bool_or(state IS NULL) AS m FROM seen LEFT JOIN states2 USING (source_id) GROUP BY ALL)
SELECT segment_id, CASE WHEN w OR m THEN '' ELSE text END AS text, array_to_string(list_filter([CASE WHEN w THEN 'source_withdrawn' END, CASE WHEN m THEN 'source_state_missing' END], lambda r: r IS NOT NULL), ',') AS reasons,
  CASE WHEN w OR m THEN 'rejected' ELSE 'accepted' END AS disposition FROM flags"""
)
def p13_dispositions(spark, d):
    customers = table(spark, d, "customer")
    states = customers.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_acctbal") < 0, "withdrawn").otherwise("active").alias("state"))
    seen = table(spark, d, "orders").selectExpr("o_orderkey as segment_id", "o_custkey as source_id", "o_orderpriority as text")
    out = policy.dispositions(seen.select("segment_id", "text"), seen, states)
    return out.select("segment_id", "text", F.array_join("reasons", ",").alias("reasons"), "disposition")


@query(
    """WITH judged AS (SELECT o_custkey AS query_id, o_orderkey AS segment_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank, o_orderstatus <> 'F' AS ok FROM orders)
SELECT query_id, segment_id, rank, CAST(CASE WHEN ok THEN count(*) FILTER (ok) OVER (PARTITION BY query_id ORDER BY rank) ELSE 0 END AS BIGINT) AS final_rank FROM judged"""
)
def w2_final_ranks(spark, d):
    order = Window.partitionBy("query_id").orderBy("o_totalprice", "segment_id")
    rows = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "query_id", "o_orderkey": "segment_id"})
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("disposition", F.when(F.col("o_orderstatus") != "F", "accepted").otherwise("rejected"))
    return policy.final_ranks(rows).select("query_id", "segment_id", "rank", "final_rank")


@query(
    """WITH t AS (SELECT c_custkey, c_custkey % 5 = 0 AS denied, c_acctbal > 0 AS active, c_custkey % 4 AS e, c_custkey % 3 AS o, c_custkey % 2 AS r FROM customer)
SELECT c_custkey, CASE WHEN denied AND NOT active THEN 'lifecycle_excluded' WHEN denied THEN 'policy_excluded' WHEN e > 0 THEN 'evidence' WHEN o > 0 THEN 'budget_omitted' WHEN r > 0 THEN 'lifecycle_excluded' ELSE 'no_matches' END AS lexical,
  CASE WHEN denied THEN 'policy_excluded' WHEN e > 0 THEN 'evidence' WHEN o = 0 THEN 'no_passages' WHEN r = 0 THEN 'no_indexed_passages' ELSE 'budget_omitted' END AS vector FROM t"""
)
def p19_outcomes(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", policy.lexical_outcome(k % 5 == 0, F.col("c_acctbal") > 0, k % 4, k % 3, k % 2).alias("lexical"), policy.vector_outcome(k % 5 == 0, k % 4, k % 3, k % 2).alias("vector")
    )


CHANGES_SQL = """changes AS (SELECT role AS source, conv_id AS item, turn AS seq, sha256(encode(coalesce(text, ''))) AS digest, (conv_id + turn) % 11 = 0 AS deleted FROM conversations),
before AS (SELECT source, item, max_by(digest, seq) AS digest, NOT max_by(deleted, seq) AS active FROM changes WHERE seq < 2 GROUP BY ALL),
incoming AS (SELECT source, item, max_by(digest, seq) AS digest, max_by(deleted, seq) AS deleted FROM changes WHERE seq >= 1 GROUP BY ALL)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return table(spark, d, "conversations").select(F.col("role").alias("source"), F.col("conv_id").alias("item"), F.col("turn").alias("seq"), text.alias("digest"), ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("deleted"))


def _before_and_incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changes = _changes(spark, d)
    before = lifecycle.latest(changes.where("seq < 2"), lifecycle.KEY, "seq").withColumn("active", ~F.col("deleted"))
    return before, lifecycle.latest(changes.where("seq >= 1"), lifecycle.KEY, "seq")


def _action_sql(absent: str, deleted: str) -> str:
    return f"""WITH {CHANGES_SQL}, acted AS (SELECT source, item, CASE WHEN i.source IS NULL THEN CASE WHEN b.active THEN {absent} END
  WHEN {deleted} THEN CASE WHEN coalesce(b.active, false) THEN 'deleted' ELSE 'absent' END WHEN b.source IS NULL THEN 'added' WHEN NOT b.active THEN 'restored' WHEN b.digest = i.digest THEN 'unchanged' ELSE 'updated' END AS action
  FROM before b FULL JOIN incoming i USING (source, item))"""


@query(_action_sql("NULL", "i.deleted") + " SELECT * FROM acted WHERE action IS NOT NULL")
def i1_changelog_actions(spark, d):
    return lifecycle.changelog_actions(*_before_and_incoming(spark, d))


@query(_action_sql("'deleted'", "false") + " SELECT * FROM acted WHERE action IS NOT NULL")
def i3_snapshot_actions(spark, d):
    before, incoming = _before_and_incoming(spark, d)
    return lifecycle.snapshot_actions(before, incoming.drop("deleted"))


@query(_action_sql("NULL", "i.deleted") + " SELECT action, count(*) AS n FROM acted WHERE action IS NOT NULL GROUP BY action")
def a7_action_counts(spark, d):
    return lifecycle.action_counts(lifecycle.changelog_actions(*_before_and_incoming(spark, d)))


@query(f"WITH {CHANGES_SQL} SELECT source, item FROM before WHERE active EXCEPT SELECT source, item FROM incoming")
def u3_vanished(spark, d):
    before, incoming = _before_and_incoming(spark, d)
    return lifecycle.vanished(before.where("active"), incoming)


@query(f"WITH {CHANGES_SQL} SELECT source, item, max_by(digest, seq) AS digest, NOT max_by(deleted, seq) AS active FROM changes GROUP BY ALL")
def snk2_replay(spark, d):
    before, _ = _before_and_incoming(spark, d)
    return lifecycle.replay(before, _changes(spark, d)).select("source", "item", "digest", "active")


@query(
    f"""WITH {CHANGES_SQL}, stored AS (SELECT CAST(item AS VARCHAR) AS id, min(digest) AS body FROM changes WHERE seq < 2 GROUP BY ALL), incoming2 AS (SELECT DISTINCT CAST(item AS VARCHAR) AS id, digest AS body FROM changes WHERE seq <= 2 AND source = 'user'),
counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM incoming2)
SELECT id, c.body, CASE WHEN n > 1 OR s.body <> c.body THEN 'conflict' WHEN s.body IS NULL THEN 'new' ELSE 'same' END AS verdict FROM counted c LEFT JOIN stored s USING (id)"""
)
def snk1_insert_or_verify(spark, d):
    changes = _changes(spark, d).withColumn("id", F.col("item").cast("string"))
    stored = changes.where("seq < 2").groupBy("id").agg(F.min("digest").alias("body"))
    return lifecycle.insert_or_verify(stored, changes.where("seq <= 2 and source = 'user'").select("id", F.col("digest").alias("body")), "id", "body")


PUSH_SQL = """pushes AS (SELECT user_id AS source, event_id AS arrival, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id // 3 + (event_id * 7) % 5 END AS sequence FROM events),
held AS (SELECT *, max(sequence) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM pushes),
gapped AS (SELECT *, high IS NOT NULL AND sequence > high + 1 AND arrival % 17 <> 0 AS has_gap FROM held),
judged AS (SELECT *, CASE WHEN sequence IS NULL THEN 'unnumbered' WHEN high IS NULL THEN 'first' WHEN sequence <= high THEN 'late' WHEN sequence = high + 1 THEN 'next' WHEN has_gap THEN 'jump' ELSE 'invalid' END AS v FROM gapped)
SELECT source, arrival, sequence, high, CASE WHEN coalesce(max(CASE WHEN v = 'invalid' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'unknown' ELSE v END AS verdict FROM judged"""


def _pushes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("user_id as source", "event_id as arrival", "if(event_id % 13 = 0, null, event_id div 3 + (event_id * 7) % 5) as sequence")
    high = F.max("sequence").over(Window.partitionBy("source").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    jump = high.isNotNull() & (F.col("sequence") > high + 1) & (F.col("arrival") % 17 != 0)
    return rows.withColumn("gap", F.when(jump, F.struct((high + 1).alias("start"), F.col("sequence").alias("stop"))))


@query("WITH " + PUSH_SQL)
def i6_sequence_verdicts(spark, d):
    return lifecycle.sequence_verdicts(_pushes(spark, d)).select("source", "arrival", "sequence", "high", "verdict")


# What must come of each kind of event, told by how it was made and not by an automaton.
@query(
    """WITH given AS (SELECT user_id, event_id AS n, CASE WHEN event_id % 29 = 0 AND coalesce(lag(event_id) OVER w % 29, 1) <> 0 AND coalesce(lag(event_id, 2) OVER w % 29, 1) <> 0 THEN 'withdraw' WHEN event_id % 4 = 0 THEN 'pull' ELSE 'push' END AS kind
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
seen AS (SELECT *, coalesce(lag(kind) OVER w = 'withdraw', false) AND n % 3 = 0 AND kind <> 'withdraw' AS down FROM given WINDOW w AS (PARTITION BY user_id ORDER BY n)),
backed AS (SELECT *, kind <> 'withdraw' AND coalesce((lag(kind) OVER w = 'withdraw' AND NOT down) OR (lag(kind, 2) OVER w = 'withdraw' AND lag(down) OVER w), false) AS resumes FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY n)),
counted AS (SELECT *, kind = 'push' AND NOT down AS push, count(*) FILTER (kind = 'push' AND NOT down) OVER (PARTITION BY user_id ORDER BY n) AS k FROM backed),
typed AS (SELECT *, CASE WHEN NOT push THEN NULL WHEN k % 11 = 0 AND NOT resumes THEN 'invalid' WHEN k % 13 = 0 THEN 'late' WHEN k % 17 = 0 THEN 'unnumbered' ELSE 'next' END AS type FROM counted),
placed AS (SELECT *, count(*) FILTER (type = 'next') OVER (PARTITION BY user_id ORDER BY n) AS m FROM typed),
told AS (
  SELECT *, CASE WHEN kind = 'withdraw' THEN 'withdrawn' WHEN down THEN 'withdrawn_source' WHEN kind = 'pull' THEN CASE WHEN n % 5 = 0 AND NOT resumes THEN 'conflict' ELSE 'pulled' END
    WHEN type = 'next' THEN CASE WHEN m = 1 THEN 'first' WHEN m % 6 = 0 THEN 'jump' ELSE 'next' END ELSE type END AS verdict FROM placed)
SELECT user_id AS source, n AS arrival, verdict, CASE WHEN m > 0 THEN CAST(m + 2 * (m // 6) AS BIGINT) END AS high FROM told
UNION ALL SELECT user_id, n, 'replay', CAST(m + 2 * (m // 6) AS BIGINT) FROM told WHERE type = 'next' AND n % 19 = 0 AND NOT resumes"""
)
def i6_ingest_stream(spark, d):
    """The whole automaton over all events, as the stream of ``streaming.ingest`` runs it by micro-batches."""
    return ingest.verdicts_of_table(spark, table(spark, d, "events"))


@query(
    """WITH r AS (SELECT o_custkey AS source, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN 'lost' ELSE CAST(o_orderkey AS VARCHAR) END AS nxt, o_orderkey AS k FROM orders),
e AS (SELECT *, lag(CAST(k AS VARCHAR)) OVER (PARTITION BY source ORDER BY seq) AS expected, lag(nxt) OVER (PARTITION BY source ORDER BY seq) AS stored FROM r)
SELECT source, seq, expected, stored FROM e WHERE expected IS DISTINCT FROM stored"""
)
def i5_checkpoint_violations(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey as source", "o_orderkey as seq", "if(o_orderkey % 9 = 0, 'lost', cast(o_orderkey as string)) as next")
    rows = rows.withColumn("expected", F.lag(F.col("seq").cast("string")).over(Window.partitionBy("source").orderBy("seq")))
    return lifecycle.checkpoint_violations(rows).select("source", "seq", "expected", "stored")


@query(
    """WITH rows AS (SELECT o_custkey AS source, o_orderkey AS seq, 'active' AS state, NULL AS withdrawal FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_custkey, o_orderkey, 'withdrawn', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')
SELECT source, r.seq, state, withdrawal FROM rows r JOIN (SELECT source, max(seq) AS seq FROM rows GROUP BY ALL) m USING (source, seq)"""
)
def i7_source_states(spark, d):
    orders = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "source", "o_orderkey": "seq"})
    return lifecycle.source_states(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'").withColumn("withdrawal", F.col("seq"))).select("source", "seq", "state", "withdrawal")


SHAPES_SQL = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'pull' ELSE 'push' END AS initiative, CASE event_id % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'snapshot' ELSE 'stream_window' END AS form, CASE WHEN event_id % 5 < 3 THEN event_id END AS covered_from, CASE WHEN event_id % 7 < 4 THEN event_id + event_id % 4 END AS covered_to, CASE WHEN event_id % 11 < 5 THEN 'c' END AS expected, CASE WHEN event_id % 4 < 2 THEN 'n' END AS next, CASE WHEN event_id % 9 < 4 THEN event_id END AS sequence FROM events"


@query(
    f"""WITH s AS ({SHAPES_SQL}) SELECT event_id, (CASE initiative WHEN 'pull' THEN next IS NOT NULL AND sequence IS NULL ELSE next IS NULL AND expected IS NULL END)
AND (CASE form WHEN 'item' THEN covered_from IS NULL AND covered_to IS NULL ELSE covered_from IS NOT NULL AND covered_to IS NOT NULL AND coalesce(covered_from < covered_to, false) END) AS holds FROM s"""
)
def p11_delivery_shapes(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    rows = spark.sql(SHAPES_SQL)
    return rows.select("event_id", F.coalesce(lifecycle.delivery_shape_holds(), F.lit(False)).alias("holds"))


LOG_SQL = "log AS (SELECT event_id + CASE WHEN event_id >= 500 THEN 1 ELSE 0 END AS seq, CASE event_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'access' ELSE 'withdrawal' END AS kind, event_id AS record_id FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id + if(event_id >= 500, 1, 0) as seq", "case event_id % 3 when 0 then 'receipt' when 1 then 'access' else 'withdrawal' end as kind", "event_id as record_id")


@query(f"WITH {LOG_SQL} SELECT seq, before FROM (SELECT seq, coalesce(lag(seq) OVER (ORDER BY seq), -1) AS before FROM log) WHERE seq <> before + 1")
def w7_log_gaps(spark, d):
    return audit.sequence_gaps(_log(spark, d), first=0)


@query(
    f"""WITH {LOG_SQL}, keys AS (SELECT o_orderkey AS id FROM orders), p AS (SELECT p_partkey AS id FROM part), s AS (SELECT s_suppkey AS id FROM supplier)
SELECT seq, kind, record_id FROM log WHERE (kind = 'receipt' AND record_id NOT IN (SELECT id FROM keys)) OR (kind = 'access' AND record_id NOT IN (SELECT id FROM p)) OR (kind = 'withdrawal' AND record_id NOT IN (SELECT id FROM s))"""
)
def j7_log_without_record(spark, d):
    tables = {"receipt": table(spark, d, "orders").selectExpr("o_orderkey as record_id"), "access": table(spark, d, "part").selectExpr("p_partkey as record_id"), "withdrawal": table(spark, d, "supplier").selectExpr("s_suppkey as record_id")}
    return audit.log_without_record(_log(spark, d), tables)
