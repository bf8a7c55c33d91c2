"""Faults that the review of the fourth round found."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def _texts(spark, words, n=150):
    r = random.Random(4)
    rows = [(f"s{i:03}", " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(n)] + [("none", None)]
    return spark.createDataFrame(rows, "segment_id string, text string").repartition(5)


def test_the_floor_is_found_without_postings(spark, monkeypatch):
    """Rows by phrase and number of occurrences are all that is stored; the terms left are those of the plain way."""
    from lodestone.functions import text as X
    from lodestone.operators import lexical, scan

    segments = _texts(spark, ["alpha", "beta", "it’s", "the", "the", "the", "zebra", "Café"])
    asked = spark.createDataFrame([(1, "alpha the it’s"), (2, "the the"), (3, "—"), (4, "nothing cafe it’s the"), (5, "")], "query_id long, text string")
    terms = asked.select("query_id", X.query_terms(F.col("text")).alias("terms"))
    posted, lengths = lexical.postings(segments), lexical.lengths(segments)
    want = sorted(map(tuple, lexical.floor_reduced(terms, posted, lengths).collect()))
    alone = lexical.phrases(terms, "query_id", "terms").select(F.col("phrase").alias("query_id"), F.array("phrase").alias("terms")).distinct()
    magnitudes = {r[0]: r[1] for r in lexical.scores(alone, posted, lengths).groupBy("query_id").agg(F.max(-F.col("score"))).collect()}

    kept = []
    stored = scan.Scratch.stored
    monkeypatch.setattr(scan.Scratch, "stored", lambda self, df, name: (kept.append(stored(self, df, name)), kept[-1])[1])
    monkeypatch.setattr(lexical, "postings", None)  # no postings are made
    strongest = scan.strongest(segments, terms)
    assert {r.phrase: r.magnitude for r in strongest.collect()} == magnitudes and len(magnitudes) == 4
    assert sorted(map(tuple, lexical.without_floor(terms, strongest).collect())) == want
    assert [set(df.columns) for df in kept] == [{"at", "f", "rows", "least", "n_tokens"}]
    assert kept[0].count() == kept[0].select("at", "f").distinct().count() < 50


@pytest.mark.parametrize("texts, queries", [(0, 2), (150, 0), (0, 0)])
def test_the_floor_of_nothing(spark, texts, queries):
    from lodestone.operators import lexical, scan

    segments = _texts(spark, ["alpha"]).limit(texts)
    terms = spark.createDataFrame([(1, ["alpha", "beta"]), (2, [])][:queries], "query_id long, terms array<string>")
    assert scan.strongest(segments, terms).count() == (1 if texts and queries else 0)
    got = sorted(map(tuple, lexical.without_floor(terms, scan.strongest(segments, terms)).collect()))
    assert got == ([(1, ["alpha", "beta"], 0, True)] if queries else [])  # alpha is in most rows, beta in none


def test_x12_moves_little(spark, monkeypatch):
    from lodestone.operators import lexical
    from lodestone.plans import texts

    monkeypatch.setattr(lexical, "postings", None)
    assert texts.x12_floor_reduction(spark, "/root/testdata/sf0.001").count() == 40


@pytest.mark.parametrize("phrase", ["a b", "a a", "a a a b", "b", "it s", "z z"])
def test_phrases_are_counted_row_by_row(spark, phrase):
    from lodestone.operators import lexical

    segments = _texts(spark, ["a", "A", "a", "b", "ab", "it’s", "-", "Ä"])
    got = lexical.text_matches(segments, phrase)
    want = lexical.phrase_matches(lexical.postings(segments), spark.createDataFrame([(phrase,)], "phrase string")).select("segment_id", "f")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert (got.count() == 0) == (phrase == "z z")


def test_x9_shuffles_nothing_and_cuts_texts_once(spark):
    from lodestone.plans import texts

    plan = texts.x9_phrase(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("array_join(") == plan.count("translate(") == 1
