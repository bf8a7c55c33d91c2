"""Items to addressed segments."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X

#: SHA-256 of no bytes: parameters of a step that has none.
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def items(documents: DataFrame, namespace: str = "corpus") -> DataFrame:
    """Documents as items of their sources, with the ids of source, observation, artifact and representation."""
    body = X.normalized(F.coalesce("text", F.lit("")))
    df = documents.select("doc_id", "source", "lang", body.alias("body"), I.content_digest(F.coalesce("text", F.lit(""))).alias("raw_sha256"))
    df = df.withColumn("content_sha256", I.content_digest(F.col("body")))
    df = df.withColumn("source_id", I.source_id(namespace, F.coalesce("source", F.lit(""))))
    df = df.withColumn("observation_id", I.observation_id(F.col("source_id"), I.observation_name(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("raw_sha256"))))
    df = df.withColumn("artifact_id", I.artifact_id(F.col("observation_id"), "raw"))
    rep = I.representation_id([("artifact", F.col("artifact_id"))], "text-normalizer", "1", F.lit(EMPTY_DIGEST), "text/plain; charset=utf-8", F.col("content_sha256"))
    return df.withColumn("representation_id", rep)


def fixed_segments(items_: DataFrame, size: int = X.SEGMENT_BYTES) -> DataFrame:
    """One row per segment: the item's columns without its body, start, stop, segment text, digest and id."""
    rest = [c for c in items_.columns if c not in ("body", "content_sha256")]
    data = F.col("body").cast("binary")
    cut = items_.withColumn("_cuts", X.fixed_cuts(data, size))
    spread = cut.select(*rest, data.alias("_data"), "_cuts", F.posexplode("_cuts").alias("ordinal", "stop"))
    start = F.coalesce(F.get("_cuts", F.col("ordinal") - 1), F.lit(0))
    spread = spread.withColumn("start", start.cast("long")).withColumn("stop", F.col("stop").cast("long"))
    piece = F.substring(F.col("_data"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    spread = spread.where("stop > start").withColumn("text", piece.cast("string")).drop("_data", "_cuts")
    return addressed(spread)


def addressed(segments: DataFrame) -> DataFrame:
    out = segments.withColumn("content_sha256", I.content_digest(F.col("text")))
    return out.withColumn("segment_id", I.segment_id(F.col("representation_id"), F.col("start"), F.col("stop"), F.col("content_sha256")))


def coordinates_hold(segments: DataFrame) -> Column:
    """Selector length, text length and digest agree."""
    return (F.col("stop") - F.col("start") == F.octet_length("text")) & (I.content_digest(F.col("text")) == F.col("content_sha256"))
