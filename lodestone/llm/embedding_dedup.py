"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Rows with the same label and equal vectors form a class that goes on as one row. In each table a
class falls into the bucket of its label and of the signs of BITS projections. Buckets are
split into blocks and each pair of blocks is one unit of work, so a large bucket is
spread over many tasks; a unit multiplies its vectors in double precision and gives out
sums only: for each class the number of rows linked to it, and a spanning forest
of the links. A pair that shares several tables is counted in the first of them.

At a cosine of 0.98 two vectors differ in one sign with probability 0.0637, so they share
none of 28 tables of 16 signs with probability (1 - 0.9363**16)**28 < 7e-6, and at 0.99 with less than 1e-8.
What moves for all vectors is the vector once and a number and a hash for each table; vectors follow only into buckets
with company.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and rows whose label is
null, link with nothing. Vectors of unequal lengths are not compared. Rows with equal ids are
rows of their own. A null id is never the smallest while there is another. Extra columns are not
read, whatever their names. Vectors of many lengths, or long ones, are taken as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, thrifty
from .graph import components

TABLES, BITS = 28, 16
#: Classes of a bucket that one unit of work holds of either side.
BLOCK = 2048


def usable(vector: str) -> Column:
    """No null or non-finite component, and one that isn't zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dimensions: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, tables * bits))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def signatures(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (vectors @ planes(vectors.shape[1], tables, bits) > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(tables: int, bits: int):
    """(node, label, rows, vector) by lengths -> those with all signatures, two bytes each."""
    assert bits <= 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("vector").offsets.to_numpy())
            for n in np.unique(size):
                part = b.filter(pa.array(size == n))
                marks = signatures(_matrix(part.column("vector")), tables, bits).astype("<u2")
                packed = pa.array([m.tobytes() for m in marks], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1) * tables, pa.int32()), pa.array(marks.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("node", "label", "rows", "vector")], pa.array(np.full(len(marks), n, np.int32)), packed, lists], names=["node", "label", "rows", "vector", "size", "marks", "list"])

    return thrifty(run)


FOUND = "a long, b long, links long"


def _work(least: float):
    """Rows of whole units, a unit's on end -> (a, null, rows linked to a) and forest edges (a, b, null)."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks().to_batches()[0]
        vectors = _matrix(rows.column("vector"))
        vectors = vectors / np.linalg.norm(vectors / np.abs(vectors).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(vectors).max(1, keepdims=True)
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), "<u2").reshape(len(vectors), -1)
        node, weight, block = (rows.column(c).to_numpy() for c in ("node", "rows", "block"))
        at = int(rows.column("at")[0].as_py())
        low, high = (int(rows.column(c)[0].as_py()) for c in ("low", "high"))
        i = np.flatnonzero(block == low)
        j = i if low == high else np.flatnonzero(block == high)
        if not len(i) or not len(j):
            return
        x, y = np.nonzero(vectors[i] @ vectors[j].T >= least)
        x, y = i[x], j[y]
        keep = x < y if low == high else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        first = np.ones(len(x), bool)
        for t in range(at):
            first &= marks[x, t] != marks[y, t]
        x, y = x[first], y[first]
        if not len(x):
            return
        links = np.bincount(x, weight[y], len(node)) + np.bincount(y, weight[x], len(node))
        hit = np.flatnonzero(links)
        # A forest: labels sink to the smallest neighbour's until they rest; each edge that changes the count of trees stays.
        parent = list(range(len(node)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        tree_x, tree_y = [], []
        star = np.unique(y, return_index=True)[1]
        rest = np.setdiff1d(np.arange(len(x)), star, assume_unique=True)
        for k in np.concatenate([star, rest]).tolist():
            if (p := root(x[k])) != (q := root(y[k])):
                parent[max(p, q)] = min(p, q)
                tree_x.append(node[x[k]])
                tree_y.append(node[y[k]])
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), none, pa.array(links[hit].astype(np.int64))], names=["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(tree_x, pa.int64()), pa.array(tree_y, pa.int64()), pa.nulls(len(tree_x), pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            unit = b.column("unit").to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(unit)], strict=True):
                if held and unit[s] != last:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = unit[s]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _floating(df: DataFrame, vector: str) -> Column:
    """The vector as it is if of float or double, else as doubles."""
    if df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>"):
        return F.col(vector)
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def link_vectors(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), _floating(df, vector).alias("vector"))
    rows = rows.withColumn("class", F.when(usable("vector") & F.col("label").isNotNull(), F.md5(F.to_json(F.struct("label", "vector")).cast("binary"))))
    classes = rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.count("*").alias("rows"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    # Dense numbers, which stay as the table is stored.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-kinds")
    kind = classes.schema["vector"].dataType.simpleString()
    hashed = stored(classes.mapInArrow(_hashed(tables, bits), f"node long, label string, rows long, vector {kind}, size int, marks binary, list array<int>"), "vector-classes")
    spread = hashed.select("node", "label", "size", F.posexplode("list").alias("at", "mark"))
    spread = spread.select("node", "at", F.xxhash64("label", "size", "at", "mark").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = spread.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "at"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("node", "bucket", "at", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    units = units.join(hashed.select("node", "rows", "vector", "marks"), "node").withColumn("unit", F.xxhash64("bucket", "low", "high"))
    found = stored(units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_work(least), FOUND), "vector-links")
    counts = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of = components(found.where("b is not null").select("a", "b"))
    named = classes.select("class", "node", "least", "rows").join(counts, "node", "left").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("class", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # Stored, so that a class of very many rows can be split.
    out = rows.select("vec_id", "class").join(stored(named, "vector-names"), "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
