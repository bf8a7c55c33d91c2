"""Each stage of the pipeline on a small table, against a plain version of its decisions."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from lodestone.llm import byte_bpe as B
from lodestone.llm.queries import tokenizer_path

from test_minhash_dedup import brute as groups
from test_suffix_dedup import brute as repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, threshold string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


WORDS = [w + e for w in "river stone light garden winter paper morning window silver harbour forest letter".split() for e in ("", "s", "ed", "ing", "ly")]


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(11)
    rows = [(i, prose(r, r.randint(40, 160)), "en", f"src{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", "en", "src1") for i in range(8)]
    passage = prose(r, 70)
    rows += [(200 + i, f"{prose(r, 60)} {passage} {prose(r, 60)}", "en", "src2") for i in range(5)]
    rows += [(300, None, "en", "src0"), (301, "", None, None), (None, prose(r, 50), "en", "src0"), (302, "é" * 200, "en", "src0")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x") for i, t, g, s in rows], SCHEMA).repartition(3).cache()


def test_quality(spark, documents, tmp_path):
    r = random.Random(12)
    junk = [(400 + i, "".join(r.choice("%$#&QXZ!{}~^") for _ in range(300)), "en", "src0", 300, "x") for i in range(4)]
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents.unionByName(spark.createDataFrame(junk, SCHEMA))
    got = P.quality(spark, docs, str(tmp_path))
    ids = {x.doc_id for x in got.collect()}
    assert got.columns == docs.columns
    assert not ids & set(range(400, 404))
    assert ids >= {*range(60), 300, 301, None}


def test_near_dedup(spark, documents):
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    named = {i: (n, c) for i, (n, c) in groups([(i if i is not None else 10_000, t) for i, t in rows], 5, 80).items()}
    expected = {i for i, (n, c) in named.items() if not n or i == c}
    got = P.near_dedup(spark, documents, "")
    assert got.columns == documents.columns
    assert {10_000 if x.doc_id is None else x.doc_id for x in got.collect()} == expected


def test_passage_dedup(spark, documents):
    rows = documents.where("doc_id is not null").collect()
    expected = {}
    for x, (gone, _, kept) in zip(rows, repeats([x.text for x in rows], P.PASSAGE), strict=True):
        if not gone or kept:
            expected[x.doc_id] = kept.decode("utf-8", "ignore")
    got = {x.doc_id: x for x in P.passage_dedup(spark, documents, "").collect() if x.doc_id is not None}
    assert {i: x.text for i, x in got.items()} == expected
    assert all(x.n_chars == len(x.text) for x in got.values() if x.text)
    given = {x.doc_id: x.text for x in rows}
    assert all(len(given[200 + i]) - len(got[200 + i].text) >= P.PASSAGE for i in range(5))


def test_mix(spark, documents):
    given = {x.doc_id: x.text for x in documents.collect()}
    got = P.mix(spark, documents, "")
    assert got.columns == documents.columns
    rows = got.collect()
    assert all(given[x.doc_id] == x.text for x in rows)
    words = lambda texts: sum(len((t or "").split()) for t in texts)
    assert words(x.text for x in rows) <= 0.9 * words(given.values())
    assert words(x.text for x in rows) >= 0.5 * words(given.values())


def test_tokens(spark, documents):
    merger = B.vocabulary(tokenizer_path("byte_bpe_50k.tiktoken"))
    assert merger.data.size > 0
    for x in P.tokens(spark, documents, "").collect():
        text = documents.where(documents.doc_id.eqNullSafe(x.doc_id)).first().text
        assert x.decodes
        assert x.n_tokens == len(x.ids)
        assert b"".join(merger.data[merger.places[i] : merger.places[i] + merger.widths[i]].tobytes() for i in x.ids) == (text or "").encode()


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_empty_table(spark, documents, tmp_path, stage):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert stage(spark, documents.limit(0), str(tmp_path)).count() == 0


CLASHING = ("doc", "bytes", "runs", "kept", "n_bytes", "n_removed", "n_spans", "domain", "n_tokens", "epoch", "c0", "id", "row", "mark")


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:4]], ids=[n for n, _ in P.STAGES[:4]])
def test_columns_of_any_name_pass(spark, documents, tmp_path, stage):
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    some = documents.where("doc_id < 12 or doc_id >= 200").selectExpr("*", *[f"'{c}-' || doc_id as {c}" for c in CLASHING])
    some.write.parquet(str(tmp_path / "some"))
    some = spark.read.parquet(str(tmp_path / "some"))
    got = stage(spark, some, str(tmp_path))
    assert got.columns == some.columns
    rows = got.collect()
    assert rows and all(x[c] == f"{c}-{x.doc_id}" for x in rows for c in CLASHING)
    # And without the column that follows the text.
    assert "n_chars" not in stage(spark, some.drop("n_chars"), str(tmp_path)).columns
