"""The stored lexical index: immutable parts, what was taken out of them since, and the merging of parts.

A part has two tables. docs: part, doc, key, scope, n_tokens, tokens. blocks: the postings of a term in a run of 128 documents, with the largest
weight that one of them has, so that a search can pass over runs that can't matter: part, term, block, n, top, avg, postings (doc, tf, n_tokens,
positions). Blocks are dealt by ranges of (term, block), so a frequent term is spread over files and statistics of a file tell its terms.

``gone`` lists documents that count no more, with their terms: statistics are always those of what is left. A document that is
indexed again is a new document of another part.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .tables import fingerprint, remove, shared_dir

#: BM25: saturation and the share of length.
K1, B = 1.2, 0.75
#: Documents of a block, as a power of 2.
BLOCK_BITS = 7

GONE = "part string, doc long, n_tokens long, terms array<string>"

_made: dict[tuple, tuple[str, str]] = {}


def weight(f: Column, n: Column, avg: Column) -> Column:
    """What a term's frequency in a row of ``n`` tokens is worth, before the term's own rarity."""
    return (f * (K1 + 1)) / (f + K1 * (1 - B + B * n / avg))


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    blocks: DataFrame
    gone: DataFrame | None = None

    def without_gone(self, rows: DataFrame) -> DataFrame:
        """``rows`` (part, doc) of documents that still count."""
        return rows if self.gone is None else rows.join(self.gone.select("part", "doc"), ["part", "doc"], "left_anti")

    def statistics(self) -> DataFrame:
        """One row: n_rows, total and average tokens."""
        rows = self.docs.select(F.lit(1).cast("long").alias("n"), "n_tokens")
        if self.gone is not None:
            rows = rows.unionByName(self.gone.select(F.lit(-1).cast("long").alias("n"), (-F.col("n_tokens")).alias("n_tokens")))
        sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        return sums.withColumn("avg_tokens", F.try_divide("n_tokens", "n_rows"))

    def terms(self, wanted: DataFrame) -> DataFrame:
        """term, df of the ``wanted`` terms: rows that hold them."""
        rows = self.blocks.select("term", "n").join(wanted, "term", "left_semi")
        if self.gone is not None:
            rows = rows.unionByName(self.gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("n")).join(wanted, "term", "left_semi"))
        return rows.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def postings(self, key: str = "segment_id") -> DataFrame:
        """term, key, tf, positions of each posting."""
        rows = self.without_gone(self.blocks.select("part", "term", F.inline("postings")))
        return rows.join(self.docs.select("part", "doc", F.col("key").alias(key)), ["part", "doc"]).select("term", key, "tf", "positions")

    def lengths(self, key: str = "segment_id") -> DataFrame:
        return self.without_gone(self.docs.select("part", "doc", F.col("key").alias(key), "n_tokens")).select(key, "n_tokens")


def tokenised(rows: DataFrame, key: str, text: str, scope: str | None) -> DataFrame:
    of = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    return rows.select(F.col(key).alias("key"), of.alias("scope"), X.tokens(F.col(text)).alias("tokens"))


def write_part(rows: DataFrame, place: str) -> str:
    """Writes ``rows`` (key, scope, tokens) as one part; gives its name."""
    part = place.rstrip("/").rsplit("/", 1)[-1]
    numbered = rows.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("doc"), "key", "scope", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    numbered.write.parquet(f"{place}/docs")
    docs = rows.sparkSession.read.schema(numbered.schema).parquet(f"{place}/docs")
    avg = docs.agg(F.avg("n_tokens")).first()[0] or 1.0
    spread = docs.select("doc", "n_tokens", F.shiftright("doc", BLOCK_BITS).alias("block"), F.posexplode("tokens").alias("position", "term"))
    # One shuffle: ranges of (term, block) hold whole blocks, so both sums stay where they are.
    each = spread.repartitionByRange("term", "block").groupBy("term", "block", "doc", "n_tokens").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    blocks = each.groupBy("term", "block").agg(
        F.count("*").alias("n"),
        F.max(weight(F.col("tf"), F.col("n_tokens"), F.lit(avg))).alias("top"),
        F.sort_array(F.collect_list(F.struct("doc", "tf", "n_tokens", "positions"))).alias("postings"),
    )
    blocks = blocks.select(F.lit(part).alias("part"), "term", "block", "n", "top", F.lit(avg).alias("avg"), "postings")
    blocks.sortWithinPartitions("term", "block").write.parquet(f"{place}/blocks")
    return part


_DOCS = "part string, doc long, key string, scope string, n_tokens long, tokens array<string>"
_BLOCKS = "part string, term string, block long, n long, top double, avg double, postings array<struct<doc:bigint,tf:bigint,n_tokens:bigint,positions:array<int>>>"


def read_parts(spark: SparkSession, places: list[str], gone: DataFrame | None = None) -> Index:
    """The index of the parts at ``places``; rows of ``gone`` that belong to other parts are passed over."""

    def of(table: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{p}/{table}" for p in places]) if places else spark.createDataFrame([], schema)

    if gone is not None:
        gone = gone.where(F.col("part").isin([p.rstrip("/").rsplit("/", 1)[-1] for p in places]))
    return Index(of("docs", _DOCS), of("blocks", _BLOCKS), gone)


def merge_parts(spark: SparkSession, places: list[str], gone: DataFrame, place: str) -> str:
    """One part of what is left of several; what was gone from them is forgotten with them."""
    old = read_parts(spark, places, gone)
    return write_part(old.without_gone(old.docs).select("key", "scope", "tokens"), place)


def index_of(segments: DataFrame, key: str = "segment_id", text: str = "text", scope: str | None = None) -> Index:
    """The index of a plan, made once a session for the files as they are: it is made anew, and the old one removed, when one has changed."""
    spark = segments.sparkSession
    rows = segments.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *([F.col(scope).alias("scope")] if scope else []))
    name, files = (spark.sparkContext.applicationId, rows.semanticHash()), fingerprint(rows)
    made = _made.get(name)
    if made is None or made[0] != files:
        place = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        atexit.register(remove, spark, place)
        write_part(tokenised(rows, "key", "text", "scope" if scope else None), place)
        if made:
            remove(spark, made[1])
        made = _made[name] = (files, place)
    return read_parts(spark, [made[1]])
