"""A batch of queries answered by BM25 from one pass over the rows, without a stored index.

``matched`` keeps, of each row, how often the batch's phrases occur in it: a small table from which corpus statistics, the strongest score of a phrase
and all scores follow. ``best`` scores it row by row against all queries; a task hands on its ``limit`` best rows of each query only, so what is
shuffled grows with queries and tasks, not with the rows that match. The queries' phrases go to every task, as the small side of a join does.

Scores and ties are those of ``lexical.scores``: contributions are added in the order of the expression, to nine places.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..index import B, K1
from ..tables import Scratch
from .lexical import contribution, inverse_frequency, phrases, ranked

#: Rows scored at once, scores held at once (rows times queries or phrases), and queries of one pass over the counted rows.
ROWS, HELD, QUERIES = 256, 1 << 21, 1024
#: More than sums differ from their values to nine places.
NEAR = 2e-9


def _counted(wanted: list[str]):
    """Batches (key, scope, tokens) -> key, scope, n_tokens, and the numbers of the wanted phrases that occur with how often they do."""
    split = [p.split(" ") for p in wanted]
    words = pa.array(sorted({w for p in split for w in p}), pa.string())
    number = {w: i for i, w in enumerate(words.to_pylist())}
    single = np.full(len(words), -1, np.int64)
    several = []
    for i, p in enumerate(split):
        if len(p) == 1:
            single[number[p[0]]] = i
        else:
            several.append((i, [number[w] for w in p]))

    def found(ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and phrases of all places where a phrase starts."""
        known = np.flatnonzero(ids >= 0)
        one = single[ids[known]]
        yield row[known[one >= 0]], one[one >= 0]
        for phrase, parts in several:
            at = np.flatnonzero(ids[: max(len(ids) - len(parts) + 1, 0)] == parts[0])
            for j, word in enumerate(parts[1:], 1):
                at = at[(ids[at + j] == word) & (row[at + j] == row[at])]
            yield row[at], np.full(len(at), phrase, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                n = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(b.column("tokens"))
                ids = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False)
                rows, seen = map(np.concatenate, zip(*found(ids, np.repeat(np.arange(len(n)), n)), strict=True))
                pair, tf = np.unique(rows * len(wanted) + seen, return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * len(wanted)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pair % max(len(wanted), 1), tf)]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("scope"), pa.array(n), *lists], names=["key", "scope", "n_tokens", "phrases", "tf"])

    return run


def _nine(x: float) -> float:
    """As ``F.round(x, 9)``."""
    return float(Decimal(repr(float(x))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) + 0.0  # no negative zero


def _best(asked: list[list[int]], idf: np.ndarray, avg: float, limit: int):
    """Batches of counted rows -> the ``limit`` best rows of each query (by its place in ``asked``), ties by key."""
    order = sorted(range(len(asked)), key=lambda q: -len(asked[q]))
    deep = max(map(len, asked), default=0)
    #: By place in the expression: the phrases there, of as many queries from the longest on as have one.
    places = [np.array([asked[q][j] for q in order if len(asked[q]) > j]) for j in range(deep)]
    step = max(1, min(ROWS, HELD // max(len(asked), len(idf), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, str]]] = [[] for _ in asked]
        bar = np.zeros(len(asked))  # a row without any of the phrases is no result
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                n = b.column("n_tokens").to_numpy()
                sizes = pc.list_value_length(b.column("phrases")).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), sizes)
                phrase, f = (pc.list_flatten(b.column(c)).to_numpy() for c in ("phrases", "tf"))
                worth = np.zeros((len(idf), len(n)))
                worth[phrase, row] = idf[phrase] * ((f * (K1 + 1)) / (f + K1 * (1 - B + B * n[row] / avg)))
                sums = np.zeros((len(order), len(n)))
                for p in places:
                    sums[: len(p)] += worth[p]
                keys = b.column("key")
                for i in np.flatnonzero((sums > 0).any(1) & (sums.max(1, initial=0) >= bar - NEAR)):
                    mine = held[i]
                    mine += [(_nine(-sums[i, r]), keys[int(r)].as_py()) for r in np.flatnonzero((sums[i] > 0) & (sums[i] >= bar[i] - NEAR))]
                    if len(mine) >= limit:
                        mine.sort()
                        del mine[limit:]
                        bar[i] = -mine[-1][0]
        for i, mine in enumerate(held):
            if mine:
                score, key = zip(*mine, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), order[i], np.int64)), pa.array(key, pa.string()), pa.array(score, pa.float64())], names=["at", "key", "score"])

    return run


def strongest(rows: DataFrame, queries: DataFrame, query_id: str = "query_id", terms: str = "terms", text: str = "text") -> DataFrame:
    """phrase, magnitude: the same as ``Scan.strongest`` where nothing else is asked of the rows, so that no table of them is kept.

    A contribution falls with the length of a row, so among the rows that hold a phrase equally often the shortest has the largest. What is shuffled is
    a row a phrase, number of occurrences and task; phrase -1 stands for the rows as a whole.
    """
    spark = rows.sparkSession
    wanted = sorted(r[0] for r in phrases(queries, query_id, terms).select("phrase").distinct().collect())
    none = F.lit(None).cast("string")
    cut = rows.select(none.alias("key"), none.alias("scope"), X.tokens(F.col(text)).alias("tokens"))
    counted = cut.mapInArrow(_counted(wanted), "key string, scope string, n_tokens long, phrases array<int>, tf array<int>")
    held = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("f"))), F.arrays_zip(F.col("phrases").alias("at"), F.col("tf").alias("f")))
    sums = counted.select("n_tokens", F.inline(held)).groupBy("at", "f").agg(F.count("*").alias("rows"), F.min("n_tokens").alias("least"), F.sum("n_tokens").alias("n_tokens"))
    sums = Scratch(spark, "strongest").stored(sums, "sums")
    n_rows, avg = sums.where("at < 0").agg(F.sum("rows"), F.sum("n_tokens") / F.sum("rows")).first()  # one row
    names = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "at int, phrase string"))
    df = sums.groupBy("at").agg(F.sum("rows").alias("df"))
    rated = sums.join(names, "at").join(df, "at")
    x = contribution(inverse_frequency(F.lit(n_rows), F.col("df")), F.col("f"), F.col("least"), F.lit(avg))
    return rated.groupBy("phrase").agg(F.max(F.round(x, 9)).alias("magnitude"))


class Scan:
    """One batch: ``queries`` (query_id, terms) over ``rows`` (key, text and a scope)."""

    def __init__(self, rows: DataFrame, queries: DataFrame, query_id: str = "query_id", terms: str = "terms", key: str = "segment_id", text: str = "text", scope: str | None = None) -> None:
        self.spark, self.q, self.key = rows.sparkSession, query_id, key
        self.kind = queries.schema[query_id].dataType.simpleString()
        self.asked = self._asked(queries, terms)
        self.wanted = sorted({p for _, of in self.asked for _, p in of})
        self.scratch = Scratch(self.spark, "scan")
        of = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
        cut = rows.select(F.col(key).cast("string").alias("key"), of.alias("scope"), X.tokens(F.col(text)).alias("tokens"))
        self.matched = self.scratch.stored(cut.mapInArrow(_counted(self.wanted), "key string, scope string, n_tokens long, phrases array<int>, tf array<int>"), "matched")
        self.n_rows, self.avg = self.matched.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)) / F.count("*")).first() if self.wanted else (0, None)  # one row

    def _asked(self, queries: DataFrame, terms: str) -> list[tuple]:
        """Queries with (ordinal, phrase) of their phrases, in order."""
        of = phrases(queries, self.q, terms).groupBy(self.q).agg(F.sort_array(F.collect_list(F.struct("ordinal", "phrase"))).alias("of"))
        return [(r[0], [tuple(x) for x in r["of"]]) for r in of.collect()]

    def _rated(self) -> DataFrame:
        """at, idf and the largest contribution of each phrase that occurs: sums within tasks, of a row a phrase."""
        each = self.matched.select("n_tokens", F.inline(F.arrays_zip(F.col("phrases").alias("at"), F.col("tf").alias("f"))))
        most = (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.lit(self.avg)))
        idf = inverse_frequency(F.lit(self.n_rows), F.col("df"))
        return each.groupBy("at").agg(F.count("*").alias("df"), F.max(most).alias("most")).select("at", idf.alias("idf"), F.round(idf * F.col("most"), 9).alias("magnitude"))

    def strongest(self) -> DataFrame:
        """phrase, magnitude: the best score that each phrase alone gives a row."""
        names = self.spark.createDataFrame(list(enumerate(self.wanted)), "at int, phrase string")
        return self._rated().join(names, "at").select("phrase", "magnitude")

    def best(self, limit: int, scope: str | None = None, queries: DataFrame | None = None, terms: str = "terms") -> DataFrame:
        """query_id, key, score, rank; of rows of a scope if one is given. ``queries`` may have other expressions of the same phrases."""
        asked = self.asked if queries is None else self._asked(queries, terms)
        number = {p: i for i, p in enumerate(self.wanted)}
        idf = np.zeros(len(self.wanted))
        for r in self._rated().collect() if self.wanted else []:  # a number a phrase
            idf[r["at"]] = r["idf"]
        mine = self.matched if scope is None else self.matched.where(F.col("scope") == scope)
        found = None
        for start in range(0, max(len(asked), 1), QUERIES):
            part = asked[start : start + QUERIES]
            scored = mine.mapInArrow(_best([[number[p] for _, p in of] for _, of in part], idf, self.avg or 1.0, limit), "at long, key string, score double")
            names = self.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(part)], f"at long, `{self.q}` {self.kind}")
            named = scored.join(F.broadcast(names), "at").select(self.q, F.col("key").alias(self.key), "score")
            found = named if found is None else found.unionByName(named)
        return Scratch(self.spark, "found").stored(ranked(found, self.q, self.key, limit), "best")

    def close(self) -> None:
        self.scratch.close()
