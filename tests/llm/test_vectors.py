from __future__ import annotations

import numpy as np
import pytest
from lodestone.llm import ann_forest as A
from lodestone.llm import embedding_dedup as E


def vectors() -> list[tuple]:
    r = np.random.default_rng(4)
    rows = []
    for label in range(3):
        base = r.standard_normal(16)
        rows += [(base + 0.06 * r.standard_normal(16), label) for _ in range(40)]
        rows += [(r.standard_normal(16), label) for _ in range(60)]
    rows += [(rows[5][0], 0)] * 30 + [(rows[5][0], 1)] * 3
    rows = [(v.astype(np.float32).tolist(), label) for v, label in rows]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None, *[1.0] * 15], 1), ([float("inf"), *[1.0] * 15], 2), (rows[0][0], None), ([1.0, 2.0], 0), ([2.0, 4.0], 0)]
    return [(i * 5, v, label, "x") for i, (v, label) in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def usable(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [512, 16])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    n = len(rows)
    linked = np.eye(n, dtype=bool)
    for i in range(n):
        for j in range(i):
            (_, a, la, _), (_, b, lb, _) = rows[i], rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                linked[i, j] = linked[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    reach = linked
    while not np.array_equal(nxt := (reach.astype(int) @ reach) > 0, reach):
        reach = nxt
    expected = {rows[i][0]: (int(linked[i].sum()) - 1, rows[int(np.flatnonzero(reach[i])[0])][0]) for i in range(n)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == expected


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 60)
    monkeypatch.setattr(A, "QUERIES", 3)
    rows = vectors()
    got: dict[int, list] = {}
    for r in sorted(A.nearest(spark.createDataFrame(rows, SCHEMA), every=20, top=5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q, v, *_ in rows:
        if q % 20 or not usable(v):
            continue
        near = []
        for i, u, *_ in rows:
            if i != q and usable(u) and len(u) == len(v):
                a, b = np.array(v, float), np.array(u, float)
                near.append((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i))
        near = sorted((round(s, 12), i) for s, i in near)[:5]
        assert len(got.get(q, [])) == len(near)
        hits += len({i for _, i in near} & {i for i, _ in got.get(q, [])})
        total += len(near)
    assert hits / total >= 0.9


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (0, [1.0, 0.0], 1, ""), (None, [1.0, 0.0], 1, ""), (50, [1.0, 1.0], 1, "")], SCHEMA)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in E.link_vectors(df).collect()) == [(False, 0, 2, 0), (False, 0, 2, 0), (False, 50, 0, 50), (True, 0, 2, 0)]
    assert sorted((r.query_id, r.vec_id) for r in A.nearest(df).collect()) == [(0, 50), (50, 0), (50, 0)]
    assert E.link_vectors(df.limit(0)).count() == 0
    assert A.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "most"), [(2_000, 0.45), (20_000, 0.25)])
def test_recall_while_a_share_is_scored(n, most):
    """Vectors without structure, the hardest case: nothing is near. The whole forest prunes, no shard is scanned."""
    r = np.random.default_rng(6)
    rows = r.standard_normal((n, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = rows[::50][:100]
    forest = A.Forest(rows, rows.mean(0))
    found = list(forest.candidates(asked, A.enough_of(n)))
    cosines = asked @ rows.T
    cosines[np.arange(len(asked)), np.arange(len(asked)) * 50] = -2
    best = np.argsort(-cosines, 1)[:, :5]
    assert np.mean([np.isin(b, f).mean() for b, f in zip(best, found, strict=True)]) >= 0.9
    assert np.mean([len(f) / n for f in found]) <= most


def test_equal_vectors_tie_wherever_they_stand(spark):
    v = [0.1, 0.7, -0.3, 0.2]
    rows = [(i, v if i % 3 else [0.1, 0.69, -0.31, 0.2], 0, "") for i in range(1, 40)] + [(0, [0.1, 0.7, -0.3, 0.21], 0, "")]
    got = sorted((r["rank"], r.vec_id) for r in A.nearest(spark.createDataFrame(rows, SCHEMA), every=50, top=5).collect())
    assert got == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]
