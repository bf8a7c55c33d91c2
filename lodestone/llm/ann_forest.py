"""Approximate nearest neighbours by a hash-prefix forest.

Each vector has one long string of hash bits per tree, the signs of random projections after the
mean of a bounded sample is taken off. A tree is the sorted array of its strings. A query descends in
every tree to the longest prefix that any string shares with its own; then all trees
ascend together, one bit at a time, each step widening the ranges in the arrays to the
strings that share one bit less, until enough candidates are met; within the last step, tree after tree. Their cosines are
computed in double precision on the original vectors, those that decide by correctly rounded sums, so that equal
vectors tie wherever they stand.

The index is dealt into shards; each shard holds a forest of its own rows. Queries come in blocks,
and each pair of a block and a shard is a unit of work, which gives the best of its shard for
each query; the best of all shards follow by an aggregation. Of n rows, SPREAD * n ** POWER are enough candidates:
many trees find neighbours at long prefixes, where few others are met, so the share that is scored falls as n grows.

Equal vectors tie, and only the smallest ids among them can be returned: of each vector the
``top`` + 1 smallest ids are kept (one may be the query's own), which loses nothing.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as
queries or candidates, nor do rows whose id is null; vectors of another length are not candidates. Repeated rows each
count as rows; a query's own row is known by its id. Fewer candidates than asked for give fewer rows. Extra columns
are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .embedding_dedup import _matrix, usable

TREES, BITS = 384, 32
SPREAD, POWER = 2.5, 0.75
SHARD, QUERIES = 32768, 4096
#: Rows of which the mean is taken.
SAMPLE = 4096
#: Scores this close to a place in the ranking are computed again by correctly rounded sums.
NEAR = 1e-9


def enough_of(n: int) -> int:
    """Candidates that a query meets at least among n rows."""
    return min(n, math.ceil(SPREAD * n**POWER))


class Forest:
    def __init__(self, vectors: np.ndarray, mean: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.trees, self.bits, self.mean = trees, bits, mean
        self.planes = np.random.default_rng([11, vectors.shape[1]]).standard_normal((trees, vectors.shape[1], bits)).astype(np.float32)
        strings = self.strings(vectors)
        self.order = np.empty(strings.shape, np.int32)
        for t in range(trees):
            self.order[t] = np.argsort(strings[t], kind="stable")
            strings[t] = strings[t, self.order[t]]
        self.sorted = strings

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """By tree, one word for each vector, its first bit highest."""
        unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean).astype(np.float32)
        out = np.empty((self.trees, len(vectors)), np.uint32)
        for t in range(self.trees):
            signs = np.packbits(unit @ self.planes[t] > 0, axis=1)
            out[t] = np.ascontiguousarray(signs).view(">u4")[:, 0]
        return out

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range of strings that share ``depth`` bits."""
        rest = np.uint64(self.bits - depth)
        low = (strings.astype(np.uint64) >> rest) << rest
        high = low + (np.uint64(1) << rest) - np.uint64(1)
        a, b = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for t in range(self.trees):
            a[t] = np.searchsorted(self.sorted[t], low[t].astype(np.uint32), "left")
            b[t] = np.searchsorted(self.sorted[t], high[t].astype(np.uint32), "right")
        return a, b

    def descend(self, strings: np.ndarray) -> np.ndarray:
        """Longest prefix that any string of a tree shares with each query's."""
        best = np.zeros(strings.shape, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], strings[t])
            for k in (at - 1, at):
                apart = self.sorted[t][np.clip(k, 0, self.sorted.shape[1] - 1)] ^ strings[t]
                shared = self.bits - np.frexp(apart.astype(np.float64))[1]
                best[t] = np.maximum(best[t], np.where((k >= 0) & (k < self.sorted.shape[1]), shared, 0))
        return best

    def candidates(self, vectors: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Rows for each query, at least ``enough`` of them if there are so many."""
        strings = self.strings(vectors)
        depth = self.descend(strings).max(0)
        n = self.sorted.shape[1]
        enough = min(enough, n)
        # Where all trees together hold too few strings, no union can be enough: only the last two steps are looked at.
        last = np.zeros(len(vectors), np.int64)
        inner: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in range(int(depth.max(initial=0)), -1, -1):
            inner[d] = self.ranges(strings, d)
            last = np.where((last == 0) & ((inner[d][1] - inner[d][0]).sum(0) >= enough), d + 1, last)
            if (last > 0).all():
                break
        floor = min(inner, default=0)
        row = np.zeros(n, bool)
        for q in range(len(vectors)):
            row[:] = False
            d = max(int(last[q]) - 1, floor)
            met = 0
            if d + 1 in inner:
                met = self._mark(row, inner[d + 1], q, n)
            while met < enough:
                if d not in inner:
                    inner[d] = self.ranges(strings, d)
                met = self._mark(row, inner[d], q, enough)
                if d == 0:
                    break
                d -= 1
            yield np.flatnonzero(row)

    def _mark(self, row: np.ndarray, ranges: tuple[np.ndarray, np.ndarray], q: int, enough: int) -> int:
        """Marks what the trees' ranges hold, eight trees at a time, until enough is marked."""
        met = 0
        for t in range(self.trees):
            row[self.order[t, ranges[0][t, q] : ranges[1][t, q]]] = True
            if t % 8 == 7 or t == self.trees - 1:
                met = int(np.count_nonzero(row))
                if met >= enough:
                    break
        return met


def cosine(a: list[float], b: list[float]) -> float:
    """By correctly rounded sums: the same for the same components, whatever stands around them."""
    size = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / size


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, top: int) -> tuple[list, list, list]:
    """Best of these rows for each query: (query ids, ids, scores)."""
    forest = Forest(vectors, mean)
    # Scaled, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    norms = np.linalg.norm(vectors, axis=1)
    out: tuple[list, list, list] = ([], [], [])
    for q, (query, rows) in enumerate(zip(queries, forest.candidates(queries, enough_of(len(ids)) + top + 1), strict=True)):
        rows = rows[ids[rows] != query_ids[q]]
        if not len(rows):
            continue
        query = query / np.abs(query).max()
        score = vectors[rows] @ query / (norms[rows] * np.linalg.norm(query))
        least = np.partition(score, max(len(score) - top, 0))[max(len(score) - top, 0)]
        close = rows[score >= least - NEAR]
        exact = np.array([cosine(vectors[i].tolist(), query.tolist()) for i in close])
        best = np.lexsort((ids[close], -exact))[:top]
        out[0].extend([query_ids[q]] * len(best))
        out[1].extend(ids[close[best]])
        out[2].extend(exact[best])
    return out


def _work(means: dict[int, list[float]], top: int):
    """Rows of whole units, a unit's on end -> (query_id, vec_id, score)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        asks = np.asarray(rows.column("asks"))
        vectors = _matrix(rows.column("vector"))
        ids = rows.column("vec_id").to_numpy()
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(v):
            return pa.RecordBatch.from_pylist([], schema=RESULT)
        mean = np.array(means.get(vectors.shape[1]) or np.zeros(vectors.shape[1]))
        a, b, s = search_block(ids[v], vectors[v], ids[q], vectors[q], mean, top)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], schema=RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            unit = b.column("unit").to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(unit)], strict=True):
                if held and unit[s] != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = unit[s]
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(df: DataFrame, every: int = 50, top: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest of each row whose id ``every`` divides."""
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), double.alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    rows = stored(rows.withColumn("size", F.size("vector")), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= top + 1).drop("_n")
    # Lengths and their rows; few lengths, as the columns of one model have one.
    sizes = {r["size"]: (r["n"], r["q"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    means: dict[int, list[float]] = {}
    for size in sizes:
        sample = _sampled(rows, size)
        if len(sample):
            means[size] = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).mean(0).tolist()
    n, q = (max([1, *(x[k] for x in sizes.values())]) for k in (0, 1))
    shards, blocks = max(-(-n // SHARD), 1), max(-(-q // QUERIES), 1)
    # Each row goes to its shard once for each block of queries, each query to its block once for each shard.
    index = kept.select("vec_id", "vector", "size", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = asking.select("vec_id", "vector", "size", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    units = index.unionByName(queries).withColumn("unit", F.xxhash64("size", "shard", "block"))
    found = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_work(means, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _sampled(rows: DataFrame, size: int) -> np.ndarray:
    """At most SAMPLE vectors of this length, the same ones each time."""
    some = rows.where(F.col("size") == size).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vector").toArrow()
    return np.array(some.column("vector").to_pylist(), np.float64).reshape(-1, size)
