from __future__ import annotations

import random
import re

import pytest
from lodestone.llm import graph
from lodestone.llm import minhash_dedup as M


def shingles(text: str | None, width: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple], width: int, percent: int) -> dict:
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {rows[i][0]: (len(sets[i]), min(rows[k][0] for k in g)) for g in groups.values() for i in g}


def documents(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out: list[str | None] = [None, "", " \t\n", "One two", "one  TWO", "one"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([8, 30, 120, 400, 900]))]
        for _ in range(r.randint(1, 6)):
            copy = [w if r.random() > 0.02 else r.choice(words) for w in base]
            out.append(" ".join(copy).upper() if r.random() < 0.3 else "  ".join(copy))
    out += [passage + " " + " ".join(r.choice(words) for _ in range(20)) for _ in range(60)]
    r.shuffle(out)
    return [(1000 - i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("width", "percent", "short"), [(3, 85, 2), (5, 80, 32)])
def test_against_brute_force(spark, width, percent, short, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(M, "SHORT", short)
    rows = documents(width)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_repeated_rows_nulls_and_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(300))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words that are not like these"), (None, "A B c d e f"), (None, None), (7, long), (None, long + " x"), (None, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in M.near_duplicates(df).collect()))
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 3, 5, True), (0, 2, 5, False), (0, 0, 0, True), (7, 296, 7, True), (0, 297, 7, False), (0, 2, 0, True)])
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    path = list(range(200))
    random.Random(1).shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((1000, 1001 + i) for i in range(50)), (3000, 3000), (2001, 2000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = dict.fromkeys(path, 0) | dict.fromkeys(range(1000, 1051), 1000) | {2000: 2000, 2001: 2000}
    assert got == expected


def test_bound_of_shared_values():
    assert 70 <= M.shared_at_least(0.85) <= 90
    assert M.shared_at_least(0.8) < M.shared_at_least(0.85)


def test_similar_sets_share_a_listed_value():
    import numpy as np

    r = np.random.default_rng(5)
    crowd = r.integers(0, 50, M.CELLS).astype(np.int64)
    passage = r.integers(0, 2**63, 400).astype(np.uint64)
    crowd[(passage & np.uint64(M.CELLS - 1)).astype(np.int64)] = 10_000
    for _ in range(400):
        n = int(r.integers(1, 900))
        base = np.concatenate([r.integers(0, 2**63, n).astype(np.uint64), passage[: int(r.integers(0, 400))]])
        t = float(r.choice([0.8, 0.85]))
        other = np.concatenate([base[int(len(base) * (1 - t) * r.random()) :], r.integers(0, 2**63, int(len(base) * 0.05)).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        if len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b)):
            shared = len(np.intersect1d(*(M.to_list(x, crowd, 1000.0, t) for x in (a, b))))
            assert shared >= min(M.OVERLAP, -(-int(100 * t + 0.5) * max(len(a), len(b)) // 100))
