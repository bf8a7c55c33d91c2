"""The stored index: rewritten files, and searches that leave out what can't matter."""

from __future__ import annotations

import random

import pytest
from lodestone import index as indexes
from lodestone.operators import lexical, pruned
from pyspark.sql import functions as F


def test_a_rewritten_file_is_seen(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")

    def put(text: str) -> None:
        spark.createDataFrame([("k", text)], "segment_id string, text string").toPandas().to_parquet(path)

    def found(word: str) -> int:
        asked = spark.createDataFrame([(0, [word])], "query_id long, terms array<string>")
        return pruned.best(indexes.index_of(spark.read.parquet(path)), asked, 10).count()

    put("apple pear")
    assert (found("zebra"), found("pear")) == (0, 1)
    before = set(indexes._made.values())
    put("zebra pear")
    assert (found("zebra"), found("apple")) == (1, 0)
    # The index of the old file is gone, and a second search makes none.
    now = set(indexes._made.values())
    assert len(now) == len(before) and found("pear") == 1 and set(indexes._made.values()) == now


@pytest.mark.parametrize("scope", [None, "s1"])
def test_pruned_search_against_all_scores(spark, tmp_path, monkeypatch, scope):
    monkeypatch.setattr(indexes, "BLOCK_BITS", 3)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    often = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(words, often, k=rng.randrange(3, 40))) for _ in range(600)]
    # Rare terms stand in some blocks only.
    texts = [t + (" rare needle" if 100 <= i < 130 and i % 2 else "") + (" odd" if i == 300 else "") for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(f"k{i:04}", f"s{i % 3}", t) for i, t in enumerate(texts)], "segment_id string, source string, text string")
    parts = [rows.where("segment_id < 'k0250'"), rows.where("segment_id >= 'k0250' and segment_id < 'k0610'")]
    places = [f"{tmp_path}/p{i}" for i in range(2)]
    for part, place in zip(parts, places, strict=True):
        indexes.write_part(indexes.tokenised(part, "segment_id", "text", "source").coalesce(2), place)
    every = indexes.read_parts(spark, places)
    removed = every.docs.where("key like 'k01%5' or key like 'k03%1'").select("part", "doc", "n_tokens", F.array_distinct("tokens").alias("terms"))
    removed.write.parquet(f"{tmp_path}/gone")
    index = indexes.read_parts(spark, places, spark.read.schema(indexes.GONE).parquet(f"{tmp_path}/gone"))
    kept = rows.where("not (segment_id like 'k01%5' or segment_id like 'k03%1')")
    asked = spark.createDataFrame(
        [(0, ["w0", "rare", "w1", "w2"]), (1, ["w0"]), (2, ["w40", "w0", "w0", "w3"]), (3, ["rare needle", "w5", "odd"]), (4, ["nothing"]), (5, ["w1 w0", "w30"]), (6, ["w0", "w1", "w2", "w3", "needle", "w59", "w58"])],
        "query_id long, terms array<string>",
    )
    scored = lexical.scores(asked, lexical.postings(kept), lexical.lengths(kept))
    if scope:
        scored = scored.join(kept.where(F.col("source") == scope), "segment_id", "left_semi")
    want = sorted(tuple(r) for r in lexical.ranked(scored, limit=7).select("query_id", "segment_id", "score", "rank").collect())
    work = pruned.Search(index, asked, 7, scope)
    got = sorted(tuple(r) for r in work.best().select("query_id", "segment_id", "score", "rank").collect())
    assert got == want
    # Fewer postings are scored than match.
    looked, matches = work.scored.count(), lexical.phrase_matches(lexical.postings(kept), lexical.phrases(asked, "query_id", "terms")).join(lexical.phrases(asked, "query_id", "terms"), "phrase").count()
    assert looked < 0.5 * matches, (looked, matches)
    work.close()


def test_empty_index_and_queries(spark, tmp_path):
    none = spark.createDataFrame([], "segment_id string, source string, text string")
    indexes.write_part(indexes.tokenised(none, "segment_id", "text", "source"), f"{tmp_path}/p")
    index = indexes.read_parts(spark, [f"{tmp_path}/p"])
    asked = spark.createDataFrame([(0, ["a"]), (1, [])], "query_id long, terms array<string>")
    assert pruned.best(index, asked, 5).count() == 0
    assert pruned.best(indexes.read_parts(spark, []), asked, 5).count() == 0
    assert pruned.best(index, asked.limit(0), 5).count() == 0
