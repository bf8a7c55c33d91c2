"""Language identification: features against a plain version, held-out accuracy, the fit's penalties, edge cases."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from lodestone.llm import language_id
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01/documents.parquet"


def plain_counts(text: str) -> Counter:
    s, out, m = f" {text.lower()} ", Counter(), (1 << 64) - 1
    for i in range(len(s)):
        held = 0
        for n in range(1, max(language_id.ORDERS) + 1):
            if i + n > len(s):
                break
            held = (held + ord(s[i + n - 1]) + n) * 0x9E3779B97F4A7C15 & m
            out[held >> (64 - language_id.BITS)] += 1
            held ^= held >> 29
    return out


def test_counts_by_blocks(monkeypatch):
    for text in ("", "a", "ab", "Étude ñandú 日本", "x" * 100, "the quick brown fox " * 9):
        for block in (1 << 19, 7, 3):
            monkeypatch.setattr(language_id, "BLOCK", block)
            found = language_id.counts(text)
            assert {int(i): int(found[i]) for i in np.flatnonzero(found)} == dict(plain_counts(text)), (text, block)


def test_held_out_accuracy_and_nothing_but_the_text(spark):
    documents = spark.read.parquet(SF)
    found = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    apart = found[found.held_out]
    assert len(apart) > 100 and (apart.lang_pred == apart.lang).mean() > 0.98 and found.score.between(0, 1).all()
    # Languages of held-out rows are hidden, sources and ids of others too: nothing changes.
    hidden = documents.withColumn("lang", F.when(language_id.fold(F.col("doc_id")) != 0, F.col("lang"))).withColumn("source", F.lit("other"))
    again = language_id.identify(hidden).toPandas().merge(found, on="doc_id")
    assert (again.lang_pred_x == again.lang_pred_y).all() and (again.score_x == again.score_y).all()


def test_edge_cases(spark):
    rows = [(i, f"{'der die und nicht' if i % 2 else 'the and with that'} {i}", "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 --- ½²", "de"), (103, "the and " * 40_000, None), (None, "und nicht", None), (3, rows[3][1], "de")]
    documents = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    found = language_id.identify(documents, sample=40).collect()
    assert len(found) == 66
    got = {r.doc_id: r for r in found}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"] and got[100].score == 0
    assert got[None].held_out and all(got[i].lang_pred == lang for i, _, lang in rows)
    # Without anything to learn from, and without rows.
    assert {r.lang_pred for r in language_id.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(documents.limit(0)).count() == 0
    alone = language_id.identify(documents.where("lang = 'de'"), sample=1).where("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("de", 1.0)}


def test_penalties_and_temperature(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i % 2, np.array([i % 2, 5 + int(rng.integers(40))]), np.array([0.8, 0.6])) for i in range(200)]
    weights, _ = language_id.fit(rows, 2)
    assert weights[0, 0] > 0 > weights[0, 1] and weights[1, 1] > 0 > weights[1, 0]
    monkeypatch.setattr(language_id, "L1", 1.0)
    sparse, _ = language_id.fit(rows, 2)
    assert (sparse != 0).sum() < (weights != 0).sum()
    monkeypatch.setattr(language_id, "L2", 50.0)
    assert np.abs(language_id.fit(rows, 2)[0]).max() < np.abs(sparse).max()
    logits = rng.normal(size=(5000, 3))
    own = np.array([rng.choice(3, p=p) for p in language_id._chances(logits)])
    assert abs(language_id.temperature(logits * 4, own) - 4) < 0.4
    assert language_id.temperature(np.zeros((0, 3)), np.array([], int)) == 1.0
