"""Checks of stored records against what they are derived from, run bookkeeping, and renderings of results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import packing


def violations(records: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Records that break rules (columns that should be true), with the names of those; a null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return records.withColumn("violations", broken).where(F.size("violations") > 0)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """One spelling of a record: names in ascending order, no white space, nulls left out."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def verified_evidence(evidence: DataFrame, items: DataFrame, key: str, body: str = "body") -> DataFrame:
    """evidence (key, start, stop, content_sha256) with ``verdict``: verified, unknown_item, bad_range or bad_digest."""
    data = items.select(key, F.encode(F.col(body), "utf-8").alias("_data"))
    met = evidence.join(data, key, "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.octet_length("_data"))
    piece = F.substring("_data", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    verdict = F.when(F.col("_data").isNull(), "unknown_item").when(~inside, "bad_range").when(F.sha2(piece, 256) != F.col("content_sha256"), "bad_digest").otherwise("verified")
    return met.withColumn("verdict", verdict).drop("_data")


def verified_selections(stored: DataFrame, used: DataFrame, budget: int, query_id: str = "query_id") -> DataFrame:
    """query_id, n_wrong, used_differs: stored selections that packing the stored candidates again doesn't give.

    stored: query_id, rank, bytes, selected. used: query_id, used_bytes as stored.
    """
    packed = packing.gathered(stored, query_id, "bytes", "selected").withColumn("again", packing.pack(F.col("candidates"), budget))
    wrong = F.size(F.filter(F.arrays_zip("candidates", F.col("again.flags").alias("flags")), lambda p: p["candidates"]["selected"] != p["flags"]))
    out = packed.select(query_id, wrong.cast("long").alias("n_wrong"), F.col("again.used").alias("_used")).join(used, query_id)
    return out.select(query_id, "n_wrong", (F.col("_used") != F.col("used_bytes")).alias("used_differs")).where((F.col("n_wrong") > 0) | F.col("used_differs"))


def candidate_faults(rows: DataFrame, query_id: str = "query_id", key: str = "segment_id", score: str = "score") -> DataFrame:
    """query_id and faults of rankings: ranks that aren't 1 to n, keys that come twice, scores that get better."""
    order = Window.partitionBy(query_id).orderBy("rank")
    seen = rows.withColumn("_before", F.lag(score).over(order))
    found = seen.groupBy(query_id).agg(
        ((F.min("rank") != 1) | (F.max("rank") != F.count("*")) | (F.countDistinct("rank") != F.count("*"))).alias("ranks"),
        (F.countDistinct(key) != F.count("*")).alias("keys"),
        (F.count_if(F.col("_before") > F.col(score)) > 0).alias("scores"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("ranks", "keys", "scores")]))
    return found.select(query_id, F.array_join(names, ",").alias("faults")).where("faults <> ''")


def limited(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with ``overflow``: whether there is one more."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    some = rows.withColumn("rank", place).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy(by)) > limit
    return some.withColumn("overflow", more).where(F.col("rank") <= limit)


def sequenced(rows: DataFrame, by: str, order: str, last: DataFrame) -> DataFrame:
    """Rows with ``seq``, which goes on from ``last`` (by, last_seq) in each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long")
    return rows.join(last, by, "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)).cast("long") + place).drop("last_seq")


def pending(asked: DataFrame, journal: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Queries without a result in the journal. A journal that holds a query twice is an error."""
    if not journal.groupBy(query_id).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("the journal holds a query twice")
    return asked.join(journal.select(query_id), query_id, "left_anti")


def table_digest(df: DataFrame, columns: list[str]) -> Column:
    """A sum over rows of 52 bits of their digests: the same in any order, another if a row is gained, lost or changed."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return F.sum(F.conv(F.substring(row, 1, 13), 16, 10).cast("decimal(38,0)")).cast("string")


def manifest(tables: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """A row per table of a run: name, n_rows, digest."""
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), table_digest(df, columns).alias("digest")) for name, (df, columns) in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def manifest_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names whose rows differ or stand on one side only: two runs match if there are none."""
    return left.exceptAll(right).unionByName(right.exceptAll(left)).select("name").distinct()


def schema_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns on one side only: column, side."""
    spark = left.sparkSession
    a, b = (spark.createDataFrame([(c,) for c in df.columns], "column string") for df in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
