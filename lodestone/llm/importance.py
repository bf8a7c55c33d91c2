"""Resampling documents by importance: those whose hashed n-grams are likelier in a target collection come first.

Each partition counts its texts in DuckDB: words unnested, runs of 1 to 3 by a window, buckets by a registered CRC. A
document's counts are one row of at most ``buckets`` entries, spilled to Parquet, so texts are read once.
Spark adds up the partitions' totals, and sums and ranks by the spilled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .common import fresh_dir, prepare, remove, stored, thrifty

BUCKETS = 10_000
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Zero bytes that one table appends to a CRC; more are appended in steps.
_STEP = 255


def _appended() -> np.ndarray:
    """For each number of zero bytes, byte of a CRC and its value: what it becomes when the bytes follow."""
    one = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    table = np.zeros((_STEP + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _STEP + 1):
        table[n] = one[table[n - 1] & 255] ^ (table[n - 1] >> np.uint32(8))
    return table.reshape(-1)


def _joined(table: np.ndarray) -> Callable[..., pa.Array]:
    def crc_join(first: pa.Array, second: pa.Array, size: pa.Array) -> pa.Array:
        """The CRC of two strings on end from their own and the second's bytes."""
        crc, left = np.asarray(first).astype(np.uint32), np.asarray(size).astype(np.int64)
        while left.any():
            step = np.minimum(left, _STEP)
            at = step * 1024
            crc = table[at + (crc & 255)] ^ table[at + 256 + ((crc >> 8) & 255)] ^ table[at + 512 + ((crc >> 16) & 255)] ^ table[at + 768 + (crc >> 24)]
            left = left - step
        return pa.array((crc ^ np.asarray(second).astype(np.uint32)).astype(np.int64))

    return crc_join


def _crc(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(t.encode()) for t in texts.to_pylist()], pa.int64())


# A word's own CRC, and that of a space and the word, are made once for each distinct word of a statement.
_WORDS = f"""CREATE OR REPLACE TEMP TABLE words AS
SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) - ahead AS starts
FROM (SELECT row, ahead, regexp_extract_all({duck.LOWER.format("text")}, '{WORD}') AS ws FROM given)"""
_DISTINCT = "CREATE OR REPLACE TEMP TABLE known AS SELECT w, crc(w) AS c, crc(' ' || w) AS s, octet_length(encode(w)) + 1 AS n FROM (SELECT DISTINCT w FROM words)"
_COUNTS = """WITH runs AS (
  SELECT row, i <= starts AS own, c AS c1, lead(s, 1) OVER a AS s2, lead(n, 1) OVER a AS n2, lead(s, 2) OVER a AS s3, lead(n, 2) OVER a AS n3
  FROM words JOIN known USING (w) WINDOW a AS (PARTITION BY row ORDER BY i)),
two AS (SELECT row, c1, crc_join(c1, s2, n2) AS c2, s3, n3 FROM runs WHERE own),
features AS (SELECT row, unnest([c1, c2, crc_join(c2, s3, n3)]) AS c FROM two)
SELECT CAST(row AS BIGINT) * {buckets} + c % {buckets} AS place, count(*) AS n FROM features WHERE c IS NOT NULL GROUP BY place ORDER BY place"""


def _counter(buckets: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duck.connect()
        db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        db.create_function("crc_join", _joined(_appended()), ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
        totals = np.zeros(buckets, np.int64)
        ids = pa.int64()
        for batch in batches:
            ids = batch.schema.field(0).type
            found = []
            for given in duck.statements(batch.column(1), GAP, 2, piece):
                db.register("given", given)
                db.execute(_WORDS)
                db.execute(_DISTINCT)
                found.append(db.sql(_COUNTS.format(buckets=buckets)).to_arrow_table())
                db.unregister("given")
            every = pa.concat_tables(found)
            place, at = np.unique(every["place"].to_numpy(), return_inverse=True)
            n = np.bincount(at, every["n"].to_numpy(), len(place)).astype(np.int64)
            totals += np.bincount(place % buckets, n, buckets).astype(np.int64)
            offsets = pa.array(np.searchsorted(place, np.arange(batch.num_rows + 1) * buckets), pa.int32())
            which = pa.ListArray.from_arrays(offsets, pa.array((place % buckets).astype(np.int32)))
            much = pa.ListArray.from_arrays(offsets, pa.array(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), which, much, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], names=["doc_id", "buckets", "counts", "totals"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([totals.tolist()], pa.list_(pa.int64()))], names=["doc_id", "buckets", "counts", "totals"])

    return thrifty(count)


def bucket_counts(texts: DataFrame, place: str, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", piece: int = duck.PIECE) -> tuple[DataFrame, DataFrame]:
    """Two views of Parquet files at ``place``: (doc_id, buckets, counts) of each text, and (bucket, n) of all.

    Every row has a row; a text without words has empty arrays. Each task adds one row with the totals of its own.
    """
    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(_counter(buckets, piece), f"doc_id {kind}, buckets array<int>, counts array<bigint>, totals array<bigint>").write.parquet(place)
    spilled = texts.sparkSession.read.parquet(place)
    totals = spilled.where(F.col("totals").isNotNull()).select(F.posexplode("totals").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    return spilled.where(F.col("totals").isNull()).drop("totals"), totals


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain from two tables of totals (bucket, n): 1000 times the log of the smoothed odds, rounded down."""
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    double = lambda c: F.col(c).cast("double")
    odds = (double("t") + 1) * (double("all_s") + buckets) / ((double("s") + 1) * (double("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, much = batch.column(1), batch.column(2)
            n = much.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(much.value_lengths().fill_null(0).to_numpy())])
            part = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)])[ends[1:]] - np.concatenate([[0], np.cumsum(x)])[ends[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), part(n), part(gain[which.flatten().to_numpy()] * n)], names=["doc_id", "n_features", "weight"])

    return thrifty(weigh)


def _noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _placed(scored: DataFrame, least: int, percent: int) -> DataFrame:
    """``rank`` for the best ``percent`` of rows of at least ``least`` features, by ranges instead of one sort."""
    spark = scored.sparkSession
    may = F.col("n_features") >= least
    quota = percent * scored.where(may).count() // 100
    order = [may.desc(), F.col("score").desc(), "doc_id", "n_features"]
    # A row's number tells its partition in the upper bits and its place there in the lower 33.
    ordered = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    offsets = spark.createDataFrame([(int(p), int(b)) for (p, _), b in zip(sizes, before, strict=False)], "part long, before long")
    place = F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    found = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return found.select("doc_id", "n_features", "weight", "score", F.when(may & (place <= quota), place).alias("rank"))


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42, piece: int = duck.PIECE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``documents`` (doc_id, text) against ``target`` (text).

    A text's features are its runs of 1 to 3 words, hashed into buckets; weight is the sum of the buckets' gains, score has
    noise by the id on top. Of the rows with ``least_words`` words, which is 2 or more, the best ``percent`` have a rank, ties by id.

    Null and empty texts have no features and weight 0. Repeated rows are rows of their own, with equal scores and ranks in a row; a null
    id counts as an empty one. An empty target leaves gains that only favour rare buckets; empty documents
    give no rows. Other columns are ignored, whatever their names. A long text is counted in parts.
    """
    spark = documents.sparkSession
    prepare(spark)
    here, there = fresh_dir(spark, "importance-raw"), fresh_dir(spark, "importance-target")
    counts, totals = bucket_counts(documents, here, buckets, piece=piece)
    _, wanted = bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), there, buckets, piece=piece)
    gain = np.zeros(buckets, np.int64)
    for r in gains(totals, wanted, buckets).collect():  # as many rows as buckets
        gain[r.bucket] = r.gain
    kind = counts.schema["doc_id"].dataType.simpleString()
    weighed = counts.mapInArrow(_weigher(gain), f"doc_id {kind}, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "importance-scores")
    for place in (here, there):
        remove(spark, place)
    return _placed(scored, 3 * least_words - 3, percent)
