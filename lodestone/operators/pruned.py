"""The best rows of many queries by BM25, without scoring what can't be among them.

A query's rarest terms are scored first: the sum of their last row within the limit is a threshold that the result can't fall below.
Terms that together can't reach it are left to the end, for rows that are nearly chosen: a row that holds nothing else isn't
in the result. Of the other terms, the stored bounds of blocks of rows tell what a row of a block can reach at most,
and only blocks that may beat the threshold are scored. What is left is scored exactly.

Scores and ties are those of ``lexical.scores``: contributions are added in the order of the expression, to nine places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..index import Index, weight
from ..tables import Scratch
from .lexical import inverse_frequency, phrases, ranked

#: Postings that give the threshold, times the limit.
FIRST = 5
#: Room for the order of sums and for rounding, so that a bound never falls below a score that it bounds.
SLACK = 1e-8


def _may_reach(bound: Column, threshold: Column) -> Column:
    return bound * (1 + 1e-9) + SLACK >= threshold


def _runs(index: Index, wanted: DataFrame) -> DataFrame:
    """Blocks of phrases of several tokens, made from the tokens' positions: like those of the index, but for what is gone."""
    parts = wanted.withColumn("_parts", F.split("phrase", " ")).where(F.size("_parts") > 1)
    parts = parts.select("phrase", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_j", "term"))
    placed = index.blocks.join(parts, "term").select("phrase", "_n", "_j", "part", "block", "avg", F.inline("postings"))
    placed = index.without_gone(placed).withColumn("_at", F.explode(F.transform("positions", lambda p: p - F.col("_j"))))
    starts = placed.groupBy("phrase", "part", "block", "doc", "_at").agg(F.count("*").alias("_hit"), F.first("_n").alias("_n"), F.first("n_tokens").alias("n_tokens"), F.first("avg").alias("avg"))
    held = starts.where("_hit = _n").groupBy("phrase", "part", "block", "doc").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("n_tokens"), F.first("avg").alias("avg"))
    return held.groupBy("phrase", "part", "block").agg(
        F.count("*").alias("n"), F.max(weight(F.col("tf"), F.col("n_tokens"), F.col("avg"))).alias("top"), F.first("avg").alias("avg"),
        F.collect_list(F.struct("doc", "tf", "n_tokens")).alias("postings"),
    )


class Search:
    """The steps of one batch. ``best`` gives the result; ``blocks``, ``scored`` and ``near`` are what it had to look at."""

    def __init__(self, index: Index, queries: DataFrame, limit: int, scope: str | None = None, query_id: str = "query_id", terms: str = "terms", key: str = "segment_id", first: int = FIRST) -> None:
        self.index, self.limit, self.scope, self.q, self.key, self.first = index, limit, scope, query_id, key, first
        self.scratch = Scratch(queries.sparkSession, "search")
        self.asked = self.scratch.stored(phrases(queries, query_id, terms), "asked")
        self.wanted = self.asked.select("phrase").distinct()
        # Queries seldom hold a term of several tokens; then nothing needs positions.
        several = not self.asked.where(F.contains("phrase", F.lit(" "))).isEmpty()
        self.runs = self.scratch.stored(_runs(index, self.wanted), "runs") if several else None

    def _blocks(self, *columns: str) -> DataFrame:
        """phrase, part, block and ``columns`` of single terms and of runs alike."""
        single = self.index.blocks.withColumnRenamed("term", "phrase")
        if "postings" in columns:
            single = single.withColumn("postings", F.transform("postings", lambda p: F.struct(p["doc"].alias("doc"), p["tf"].alias("tf"), p["n_tokens"].alias("n_tokens"))))
        single = single.select("phrase", "part", "block", *columns)
        return single if self.runs is None else single.unionByName(self.runs.select("phrase", "part", "block", *columns))

    def _terms(self) -> DataFrame:
        """query, phrase, places in the expression, idf, the mean length, df, and the most that the phrase can add to a row."""
        single = self.index.terms(self.wanted.withColumnRenamed("phrase", "term")).withColumnRenamed("term", "phrase")
        df = single if self.runs is None else single.unionByName(self.runs.groupBy("phrase").agg(F.sum("n").alias("df")))
        tops = self._blocks("top", "avg").join(self.wanted, "phrase", "left_semi").groupBy("phrase", "avg").agg(F.max("top").alias("top"))
        stats = F.broadcast(self.index.statistics().select("n_rows", "avg_tokens"))  # one row
        known = df.join(tops, "phrase").crossJoin(stats).withColumn("idf", inverse_frequency(F.col("n_rows"), F.col("df")))
        known = known.groupBy("phrase", "df", "idf", "avg_tokens").agg(F.max(F.col("top") * _grown(F.col("avg_tokens"), F.col("avg"))).alias("top"))
        placed = self.asked.groupBy(self.q, "phrase").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"))
        return placed.join(known, "phrase").withColumn("most", F.size("ordinals") * F.col("idf") * F.col("top"))

    def _postings(self, terms: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """query, part, block, doc, the phrase's places and contribution, for the postings of ``terms`` in the query's ``blocks`` or in all."""
        terms = terms.select(self.q, "phrase", "ordinals", "idf", "avg_tokens")
        on = ["phrase"] if blocks is None else ["phrase", "part", "block"]
        met = (terms if blocks is None else blocks.join(terms, self.q)).join(self._blocks("postings"), on)
        met = met.select(self.q, "part", "block", "ordinals", "idf", "avg_tokens", F.inline("postings"))
        x = F.col("idf") * weight(F.col("tf"), F.col("n_tokens"), F.col("avg_tokens"))
        return self._in_scope(self.index.without_gone(met.select(self.q, "part", "block", "doc", "ordinals", x.alias("x"))), "doc")

    def _in_scope(self, rows: DataFrame, *on: str) -> DataFrame:
        if self.scope is None:
            return rows
        mine = self.index.docs.where(F.col("scope") == self.scope).select("part", "doc", F.shiftright("doc", _bits()).alias("block"))
        return rows.join(mine.select("part", *on).distinct(), ["part", *on], "left_semi")

    def _sums(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy(self.q, "part", "block", "doc").agg(F.sum(F.size("ordinals") * F.col("x")).alias("sum"))

    def _last(self, rows: DataFrame) -> DataFrame:
        """query, last: the sum of the last row within the limit, of queries that have as many."""
        order = Window.partitionBy(self.q).orderBy(F.desc("sum"))
        nth = rows.select(self.q, "sum").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= self.limit)
        return nth.groupBy(self.q).agg(F.min("sum").alias("last"), F.count("*").alias("_n")).where(F.col("_n") == self.limit).drop("_n")

    def best(self) -> DataFrame:
        """query, key, score, rank of the best rows of each query."""
        q, stored = self.q, self.scratch.stored
        terms = stored(self._terms(), "terms")
        rarest = Window.partitionBy(q).orderBy("df", "phrase").rowsBetween(Window.unboundedPreceding, -1)
        first = terms.withColumn("_before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("_before") < self.first * self.limit)
        threshold = stored(self._last(self._sums(self._postings(first))), "threshold")

        # Terms that don't reach the threshold even together, from those that add least on.
        least = Window.partitionBy(q).orderBy("most", "phrase").rowsBetween(Window.unboundedPreceding, 0)
        dealt = terms.join(threshold, q, "left").withColumn("_upto", F.sum("most").over(least))
        dealt = stored(dealt.withColumn("leads", F.col("last").isNull() | _may_reach(F.col("_upto"), F.col("last"))), "dealt")
        leading = dealt.where("leads")
        rest = dealt.groupBy(q).agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("most"))), F.lit(0.0)).alias("rest"), F.first("last").alias("last"))
        most = F.size("ordinals") * F.col("idf") * F.col("top") * _grown(F.col("avg_tokens"), F.col("avg"))
        met = leading.select(q, "phrase", "ordinals", "idf", "avg_tokens").join(self._blocks("top", "avg"), "phrase")
        bounds = self._in_scope(met.groupBy(q, "part", "block").agg(F.sum(most).alias("bound")), "block").join(rest, q)
        alive = bounds.where(F.col("last").isNull() | _may_reach(F.col("bound") + F.col("rest"), F.col("last"))).select(q, "part", "block")
        self.blocks = stored(alive, "alive")

        self.scored = self._postings(leading, self.blocks)
        sums = stored(self._sums(self.scored), "sums")
        nearer = rest.drop("last").join(self._last(sums), q, "left")
        near = sums.join(nearer, q).where(F.col("last").isNull() | _may_reach(F.col("sum") + F.col("rest"), F.col("last")))
        self.near = stored(near.select(q, "part", "block", "doc"), "near")

        # All terms of the rows that are nearly chosen.
        full = self._postings(terms, self.near.select(q, "part", "block").distinct()).join(self.near.select(q, "part", "doc"), [q, "part", "doc"], "left_semi")
        parts = F.flatten(F.collect_list(F.transform("ordinals", lambda o: F.struct(o.alias("ordinal"), F.col("x").alias("x")))))
        whole = full.groupBy(q, "part", "doc").agg(F.sort_array(parts).alias("_parts"))
        score = F.round(-1 * F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["x"]), 9)
        named = whole.select(q, "part", "doc", score.alias("score")).join(self.index.docs.select("part", "doc", F.col("key").alias(self.key)), ["part", "doc"])
        return ranked(named.select(q, self.key, "score"), q, self.key, self.limit)

    def close(self) -> None:
        self.scratch.close()


def _bits() -> int:
    from .. import index

    return index.BLOCK_BITS


def _grown(now: Column, then: Column) -> Column:
    """How much larger a weight can be at the present mean length than at the one that a bound was made with."""
    return F.greatest(F.lit(1.0), now / then)


def best(index: Index, queries: DataFrame, limit: int, scope: str | None = None, query_id: str = "query_id", terms: str = "terms", key: str = "segment_id") -> DataFrame:
    """query_id, key, score, rank: the ``limit`` best rows of each query, of those of a scope if one is given; statistics are of all rows.

    The result is a small stored table; what it took is removed.
    """
    work = Search(index, queries, limit, scope, query_id, terms, key)
    result = Scratch(queries.sparkSession, "found").stored(work.best(), "best")
    work.close()
    return result
