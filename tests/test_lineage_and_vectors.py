"""Ancestry by rounds, exact neighbours by blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from lodestone.functions import vectors as V
from lodestone.operators import lineage, vectors
from pyspark.sql import functions as F


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def diamonds(n):
    """n diamonds on end: 2 ** n paths."""
    return [p for i in range(n) for p in ((f"a{i}", f"n{i}"), (f"b{i}", f"n{i}"), (f"n{i + 1}", f"a{i}"), (f"n{i + 1}", f"b{i}"))]


def test_many_paths_are_walked_once(spark):
    edges = edges_of(spark, diamonds(12))
    found = lineage.descendants(spark.createDataFrame([("n0",)], "root string"), edges)
    assert found.count() == found.distinct().count() == 37
    leaf = spark.createDataFrame([("n12",), ("alone",)], "leaf string")
    assert {(r.leaf, r.origin) for r in lineage.origins(leaf, edges).collect()} == {("n12", "n0"), ("alone", "alone")}
    assert {(r.leaf, r.origin, r.problem) for r in lineage.single_origin(leaf, lineage.origins(leaf, edges)).collect()} == {("n12", "n0", None), ("alone", "alone", None)}


def test_reach_against_plain(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MERGED", 3)
    rng = random.Random(4)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)] + [(None, "1"), ("1", None)]
    roots = [str(i) for i in range(0, 40, 5)] + ["5"]
    want = set()
    for root in roots:
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            for c, p in pairs:
                if p == at and c is not None and c not in seen:
                    seen.add(c)
                    todo.append(c)
        want |= {(root, n) for n in seen}
    found = [(r.root, r.node) for r in lineage.descendants(spark.createDataFrame([(r,) for r in roots], "root string"), edges_of(spark, pairs)).collect()]
    assert sorted(found) == sorted(want)


def test_paths_are_bounded_and_cycles_errors(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MAX_PATHS", 7)
    leaf = spark.createDataFrame([("n2",)], "leaf string")
    assert lineage.evidence_paths(leaf, edges_of(spark, diamonds(2))).count() == 4
    with pytest.raises(ValueError, match="paths lead up from n3"):
        lineage.evidence_paths(spark.createDataFrame([("n3",)], "leaf string"), edges_of(spark, diamonds(3)))
    with pytest.raises(Exception, match="cycle"):
        lineage.evidence_paths(leaf, edges_of(spark, [("n2", "x"), ("x", "n2")]))


@pytest.mark.parametrize("limit", [None, 3])
def test_blocks_give_the_same_bits_as_sums_in_order(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5 if i % 9 else 4)]) for i in range(60)]
    rows += [(100, rows[1][1]), (101, [2 * x for x in rows[1][1]]), (102, [0.0] * 5), (103, None), (104, [1.0, float("nan")] * 2), (105, [])]
    table = spark.createDataFrame(rows, "vec_id long, values array<double>")
    asked = table.where("vec_id % 5 = 0 or vec_id = 1").select(F.col("vec_id").alias("query_id"), "values")
    found = sorted(map(tuple, vectors.exact_neighbours(table, asked, limit=limit).select("query_id", "vec_id", "score", "rank").collect()))
    good = table.where(V.valid(F.col("values")))
    pairs = good.join(asked.where(V.valid(F.col("values"))).withColumnRenamed("values", "q"), F.size("values") == F.size("q")).select("query_id", "vec_id", V.cosine(F.col("values"), F.col("q")).alias("score")).collect()
    want = []
    for query in {p.query_id for p in pairs}:
        mine = sorted((p for p in pairs if p.query_id == query), key=lambda p: (-p.score, p.vec_id))[:limit]
        want += [(query, p.vec_id, p.score, i + 1) for i, p in enumerate(mine)]
    assert found == sorted(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, values array<double>")
    assert vectors.exact_neighbours(none, none.withColumnRenamed("vec_id", "query_id"), limit=3).count() == 0
