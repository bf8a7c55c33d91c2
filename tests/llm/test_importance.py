"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from lodestone.llm import duck, importance

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def features(text: str | None) -> list[int]:
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % importance.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows: list[tuple], target: list[str | None], percent: int = 5) -> list[tuple]:
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    n, m, b = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (n + b) / ((s[x] + 1) * (m + b))))
    out = []
    for doc_id, text in rows:
        found = features(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    best = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(best[: percent * len(best) // 100]):
        r.append(i + 1)
    return sorted(((*r[:4], r[5] if len(r) > 5 else None) for r in out), key=str)


def test_crc_of_strings_on_end():
    join = importance._joined(importance._appended())
    rng = random.Random(5)
    for size in (0, 1, 7, 254, 255, 256, 1000):
        a, b = rng.randbytes(9), rng.randbytes(size)
        assert join([zlib.crc32(a)], [zlib.crc32(b)], [size]).to_pylist() == [zlib.crc32(a + b)]


@pytest.mark.parametrize("piece", [duck.PIECE, 50])
def test_resample_against_plain(spark, piece):
    rng = random.Random(3)
    vocabulary = ["the", "Of", "étude", "Ünder", "x9", "3", "long" * 80, "日本", "zebra", "apple", "pear", "OAK"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (204, text(3000)), (7, rows[7][1]), (None, text(30))]
    target = [text(40) + " apple pear" * 20, None, "", "Oak"]
    documents = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, weight int, totals int").repartition(3)
    found = importance.resample(documents, spark.createDataFrame([(t,) for t in target], "text string"), percent=25, piece=piece)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, target, 25)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (2, None)], none.schema)
    assert importance.resample(none, some).count() == 0
    assert sorted(r.n_features for r in importance.resample(some, none).collect()) == [0, 177]
