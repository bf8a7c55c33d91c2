"""Records of all kinds made from the tables, with faults planted in their spelling, fields, values and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import canonical, corpus

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return keep


def _json(kind: str, id_: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(I.tag(kind)).alias("schema"), id_.alias("id"), *[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _records(spark: SparkSession, d: str) -> DataFrame:
    """kind, key, record."""
    items = corpus.items(spark.read.parquet(f"{d}/documents.parquet"))
    size, lit = F.octet_length("body").cast("long"), F.lit
    nothing = lit(corpus.EMPTY_DIGEST)
    source, observed = F.col("source_id"), F.col("observation_id")
    segment = I.segment_id(F.col("representation_id"), lit(0).cast("long"), size, F.col("content_sha256"))
    asked = I.tuple_hash(I.tag("request"), lit("source.retrieve"), lit("callers"), F.col("lang"), F.col("doc_id").cast("string"), lit("purposes"), lit('a "test"'), I.raw(source), I.u64(F.col("doc_id") + 1))
    decided = I.tuple_hash(I.tag("decision"), I.raw(F.col("asked")), lit("rules"), lit("1"), I.u64(F.col("doc_id") + 2), lit(b"\x01"), lit("active"), lit(b""), lit("deny"), lit(b""), lit("deny"), lit("access_denied"), lit("late"))
    spread = items.withColumn("asked", asked).select(
        F.col("doc_id").alias("key"),
        F.explode(
            F.array(
                *[
                    F.struct(lit(kind).alias("kind"), record.alias("record"))
                    for kind, record in {
                        "source": _json("source", source, namespace=lit("corpus"), external_source_id=F.col("source")),
                        "observation": _json("observation", observed, source_id=source, external_observation_id=I.observation_name(F.col("doc_id").cast("string"), F.col("raw_sha256"))),
                        "artifact": _json("artifact", F.col("artifact_id"), observation_id=observed, artifact_key=lit("raw"), media_type=lit("text/plain"), content_sha256=F.col("raw_sha256"), byte_length=size),
                        "representation": _json("representation", F.col("representation_id"), inputs=F.array(F.struct(lit("artifact").alias("kind"), F.col("artifact_id").alias("id"))), processor_id=lit("text-normalizer"), processor_version=lit("1"), parameters_sha256=nothing, media_type=lit("text/plain; charset=utf-8"), content_sha256=F.col("content_sha256"), byte_length=size),
                        "segment": _json("segment", segment, representation_id=F.col("representation_id"), selector=F.struct(lit(0).alias("start"), size.alias("stop")), content_sha256=F.col("content_sha256")),
                        "request": _json("request", F.col("asked"), action=lit("source.retrieve"), caller_namespace=lit("callers"), caller_id=F.col("lang"), request_name=F.col("doc_id").cast("string"), purpose_namespace=lit("purposes"), purpose_id=lit('a "test"'), source_id=source, requested_at=F.col("doc_id") + 1),
                        "decision": _json("decision", decided, request_id=F.col("asked"), evaluator_id=lit("rules"), evaluator_version=lit("1"), evaluated_at=F.col("doc_id") + 2, state_present=lit(True), collection_state=lit("active"), withdrawal_id=lit(None).cast("string"), access=lit("deny"), access_event_id=lit(None).cast("string"), outcome=lit("deny"), reasons=F.array(lit("access_denied"), lit("late"))),
                    }.items()
                ]
            )
        ).alias("r"),
    )
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("of", I.source_id("users", F.col("user_id").cast("string")))
    n, name = F.col("event_id"), F.concat(F.lit("é–"), F.col("event_id").cast("string"))
    access = F.when(n % 3 == 0, "deny").otherwise("allow")
    told = events.select(
        n.alias("key"),
        F.explode(
            F.array(
                F.struct(lit("withdrawal").alias("kind"), _json("withdrawal", I.withdrawal_id(F.col("of"), name), source_id=F.col("of"), external_withdrawal_id=name, occurred_at=n + 1).alias("record")),
                F.struct(lit("access-event").alias("kind"), _json("access-event", I.access_event_id(F.col("of"), access, n + 1, F.col("event_type")), source_id=F.col("of"), access=access, time=n + 1, actor=F.col("event_type")).alias("record")),
            )
        ).alias("r"),
    )
    return spread.unionByName(told).select("key", "r.kind", "r.record")


# Several faults may meet in a record; the first in the order of the checks is told.
@query(
    """WITH kinds AS (SELECT unnest(['source', 'observation', 'artifact', 'representation', 'segment', 'request', 'decision']) AS kind),
given AS (SELECT kind, doc_id AS key FROM documents, kinds UNION ALL SELECT unnest(['withdrawal', 'access-event']), event_id FROM events)
SELECT kind, key, CASE WHEN key % 43 = 8 THEN 'unknown_kind' WHEN key % 31 = 7 THEN 'syntax' WHEN key % 19 = 4 THEN 'duplicate_name' WHEN key % 11 = 1 THEN 'spelling' WHEN key % 13 = 2 THEN 'unknown_field'
  WHEN key % 17 = 3 THEN 'missing_field' WHEN key % 37 = 9 THEN 'spelling' WHEN key % 29 = 6 THEN 'bad_value' WHEN key % 23 = 5 THEN 'wrong_id' END AS fault FROM given"""
)
def p9_record_faults(spark, d):
    rows, key, r = _records(spark, d), F.col("key"), F.col("record")

    def planted(row: Column, m: int, n: int, change: Column) -> Column:
        return F.when(key % m == n, change).otherwise(row)

    rows = rows.withColumn("record", planted(r, 23, 5, F.regexp_replace(r, '"id":"[0-9a-f]{8}', '"id":"0a1b2c3d')))
    rows = rows.withColumn("record", planted(r, 29, 6, F.regexp_replace(r, '"schema":"[^"]*"', '"schema":"another"')))
    rows = rows.withColumn("record", planted(r, 37, 9, F.regexp_replace(r, '^\\{("schema":"[^"]*"),("id":"[^"]*")', r"{$2,$1")))
    rows = rows.withColumn("record", planted(r, 17, 3, F.regexp_replace(r, '"schema":"[^"]*",', "")))
    rows = rows.withColumn("record", planted(r, 13, 2, F.regexp_replace(r, "\\}$", ',"more":1}')))
    rows = rows.withColumn("record", planted(r, 11, 1, F.regexp_replace(r, "^\\{", "{ ")))
    rows = rows.withColumn("record", planted(r, 19, 4, F.regexp_replace(r, "\\}$", ',"id":"x","id":"y"}')))
    rows = rows.withColumn("record", planted(r, 31, 7, F.regexp_replace(r, "\\}$", "")))
    rows = rows.withColumn("_kind", F.when(key % 43 == 8, "another").otherwise(F.col("kind")))
    return canonical.record_faults(rows, "_kind").select("kind", "key", "fault")
