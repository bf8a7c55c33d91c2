"""Exact vector search and fusion with a lexical ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lexical import ranked


#: Vectors and queries of one matrix product.
BLOCK, QUERY_BLOCK = 8192, 512
#: Components of a block that a task takes of either side: the larger, the fewer copies of the other side are made.
HELD = 8 << 20
#: Far more than a matrix product can differ from sums in order, and more than rounding to nine places moves two scores.
ROOM = 2e-9


def exact_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", query_id: str = "query_id", vector: str = "values", limit: int | None = None, digits: int | None = None, raw: bool = False) -> DataFrame:
    """query_id, key, score, rank by cosine, ties by key. Every query meets every vector of its length: exact by definition.

    ``digits`` (nine or more) rounds scores before they are ranked, for comparison with engines that sum otherwise; ``raw`` gives them as they were.

    Both sides are dealt into blocks by a hash. A task takes the vectors of one pair of blocks, finds by matrix products which may be among the
    ``limit`` nearest of the block, and sums those again in the order of the components: scores are the same bits wherever and in
    whatever company a vector is met. The blocks' nearest are merged. Queries of one block go to all blocks of
    vectors and the other way round, which is the work of an exact search, in parts of bounded size.
    """
    v, q = _prepared(vectors, key, vector, "v"), _prepared(queries, query_id, vector, "q")
    n_v, n_q = (-(-max(df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0], 1) // HELD) for df, c in ((v, "_v"), (q, "_q")))

    def dealt(df: DataFrame, name: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    left = dealt(v, key, "_vb", n_v, "_qb", n_q).select(F.col(key).alias("_key"), "_v", "_vn", "_vb", "_qb")
    right = dealt(q, query_id, "_qb", n_q, "_vb", n_v).select(F.col(query_id).alias("_id"), "_q", "_qn", "_vb", "_qb")
    kinds = f"_id {right.schema['_id'].dataType.simpleString()}, _key {left.schema['_key'].dataType.simpleString()}, score double"
    found = left.groupBy("_vb", "_qb").cogroup(right.groupBy("_vb", "_qb")).applyInArrow(_block_nearest(limit), kinds)
    found = found.select(F.col("_id").alias(query_id), F.col("_key").alias(key), "score")
    if digits is None:
        return ranked(found, query_id, key, limit, ascending=False)
    out = ranked(found.withColumn("_near", F.round("score", digits)), query_id, key, limit, ascending=False, score="_near")
    return out.select(query_id, key, "score" if raw else F.col("_near").alias("score"), "rank")


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _block_nearest(limit: int | None):
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        lengths = [pc.list_value_length(t.column(c)).to_numpy() for t, c in ((left, "_v"), (right, "_q"))]
        for size in np.intersect1d(*map(np.unique, lengths)):
            v, q = left.filter(pa.array(lengths[0] == size)), right.filter(pa.array(lengths[1] == size))
            a, b = _matrix(v.column("_v"), size), _matrix(q.column("_q"), size)
            norms = v.column("_vn").to_numpy(), q.column("_qn").to_numpy()
            for first in range(0, len(b), QUERY_BLOCK):
                parts = []
                for start in range(0, len(a), BLOCK):
                    x, y = a[start : start + BLOCK], b[first : first + QUERY_BLOCK]
                    n, m = norms[0][start : start + BLOCK], norms[1][first : first + QUERY_BLOCK]
                    rows, at = np.indices((len(y), len(x))).reshape(2, -1)
                    if limit is not None and limit < len(x):
                        near = (y @ x.T) / m[:, None] / n
                        rows, at = np.nonzero(near >= np.partition(near, len(x) - limit, 1)[:, [len(x) - limit]] - ROOM)
                    dots = np.zeros(len(rows))
                    for i in range(size):
                        dots += x[at, i] * y[rows, i]
                    parts.append((rows, at + start, np.clip(dots / (n[at] * m[rows]), -1.0, 1.0)))
                rows, at, scores = map(np.concatenate, zip(*parts, strict=True))
                if limit is not None and len(parts) > 1:
                    # Of what each product left, the block's nearest.
                    order = np.lexsort((-scores, rows))
                    rows, at, scores = rows[order], at[order], scores[order]
                    begin = np.searchsorted(rows, np.arange(rows[-1] + 1))
                    last = scores[np.minimum(begin + limit, np.append(begin[1:], len(rows))) - 1]
                    kept = scores >= last[rows] - ROOM
                    rows, at, scores = rows[kept], at[kept], scores[kept]
                out.append(pa.table([q.column("_id").take(pa.array(rows + first)), v.column("_key").take(pa.array(at)), pa.array(scores)], names=["_id", "_key", "score"]))
        return pa.concat_tables(out) if out else pa.table([right.column("_id").slice(0, 0), left.column("_key").slice(0, 0), pa.array([], pa.float64())], names=["_id", "_key", "score"])

    return nearest


def _prepared(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Scaling and norms are worked out per row, before rows meet."""
    bound = F.transform(F.array(V.scaled(F.col(vector))), lambda x: F.struct(x.alias("x"), V.norm(x).alias("n")))
    rows = df.where(V.valid(F.col(vector))).select(key, F.explode(bound).alias("_p"))
    return rows.select(key, F.col("_p.x").alias(f"_{name}"), F.col("_p.n").alias(f"_{name}n"))


def coverage(passages: DataFrame, embeddings: DataFrame, on: list[str]) -> DataFrame:
    """One row: passages that may have a vector, that have one, that lack one."""
    have = embeddings.select(*on).distinct().withColumn("_has", F.lit(True))
    return passages.join(have, on, "left").agg(
        F.count("*").alias("eligible"), F.count("_has").alias("indexed"), (F.count("*") - F.count("_has")).alias("missing")
    )


def stale_pins(imported: DataFrame, passages: DataFrame, pins: list[str]) -> DataFrame:
    """Imported rows whose pins are no current passage's; an import is good if there are none."""
    return imported.join(passages.select(*pins), pins, "left_anti")


def changed_vectors(imported: DataFrame, stored: DataFrame, key: list[str], vector: str = "values") -> DataFrame:
    """Rows whose key is stored with other values: stored vectors never change."""
    return imported.join(stored.select(*key, F.col(vector).alias("_stored")), key).where(~F.col(vector).eqNullSafe(F.col("_stored"))).drop("_stored")


def fuse(lexical: DataFrame, vector: DataFrame, on: list[str], key: str, k: int = V.RRF_K) -> DataFrame:
    """Full outer union of two rankings (columns ``rank``) by reciprocal rank: lexical_rank, vector_rank, score, rank."""
    a = lexical.select(*on, F.col("rank").alias("lexical_rank"))
    b = vector.select(*on, F.col("rank").alias("vector_rank"))
    both = a.join(b, on, "full").withColumn("score", V.fused(F.col("lexical_rank"), F.col("vector_rank"), k=k))
    return ranked(both, [c for c in on if c != key][0], key, None, ascending=False)
