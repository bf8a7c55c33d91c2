from __future__ import annotations

import pytest
from lodestone.operators import expressions as E
from lodestone.operators import lexical, records
from lodestone.operators.expressions import Leaf, Node
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("oak", Leaf("oak")),
        ('"red oak" OR el*', Node("OR", Leaf("red oak"), Leaf("el", True))),
        ("a b NOT c", Node("AND", Leaf("a"), Node("NOT", Leaf("b"), Leaf("c")))),
        ("a OR b AND c", Node("OR", Leaf("a"), Node("AND", Leaf("b"), Leaf("c")))),
        ("(a OR b) c", Node("AND", Node("OR", Leaf("a"), Leaf("b")), Leaf("c"))),
        ('"say ""hi"""', Leaf('say "hi"')),
    ],
)
def test_parsed(text, tree):
    assert E.parse(text) == tree


@pytest.mark.parametrize("text", ["", "(a", "a)", "a OR", "AND a", "NOT a", '"open', "()"])
def test_no_expressions(text):
    with pytest.raises(ValueError):
        E.parse(text)


def test_matches(spark):
    rows = [(1, "red oak tree"), (2, "oak red"), (3, "elm and oaken"), (4, ""), (5, "Réd OAK")]
    posted = lexical.postings(spark.createDataFrame(rows, "segment_id int, text string"))

    def found(text: str) -> list[int]:
        return sorted(r.segment_id for r in E.matches(posted, E.parse(text)).collect())

    assert found('"red oak"') == [1, 5]
    assert found("red oak") == [1, 2, 5]
    assert found("oak* NOT red") == [3]
    assert found('"red oa"*') == [1, 5]
    assert found('elm OR "oak red"') == [2, 3]
    assert found('"!"') == []


def test_journal_and_manifest(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    done = spark.createDataFrame([(2,)], "query_id int")
    assert sorted(r.query_id for r in records.pending(asked, done).collect()) == [1, 3]
    with pytest.raises(ValueError):
        records.pending(asked, done.unionByName(done))
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    b = spark.createDataFrame([(2, None), (1, "y")], "id int, t string")
    one = lambda df: records.manifest({"t": (df, ["id", "t"])})
    assert records.manifest_differences(one(a), one(a.orderBy(F.desc("id")))).count() == 0
    assert [r.name for r in records.manifest_differences(one(a), one(b)).collect()] == ["t"]
    assert records.manifest_differences(one(a), one(a.unionByName(a))).count() == 1


def test_evidence_and_candidates(spark):
    items = spark.createDataFrame([(1, "aé b")], "id int, body string")
    digest = spark.range(1).select(F.sha2(F.encode(F.lit("é"), "utf-8"), 256)).first()[0]
    claims = spark.createDataFrame([(1, 1, 3, digest), (1, 0, 2, digest), (1, 3, 9, digest), (1, 2, 2, digest), (2, 0, 1, digest)], "id int, start int, stop int, content_sha256 string")
    got = {(r.id, r.start, r.stop): r.verdict for r in records.verified_evidence(claims, items, "id").collect()}
    assert got == {(1, 1, 3): "verified", (1, 0, 2): "bad_digest", (1, 3, 9): "bad_range", (1, 2, 2): "bad_range", (2, 0, 1): "unknown_item"}
    rows = [(1, "a", 1, -2.0), (1, "b", 2, -1.0), (2, "a", 2, -2.0), (3, "a", 1, -2.0), (3, "a", 2, -1.0), (4, "a", 1, -1.0), (4, "b", 2, -2.0)]
    ranked = spark.createDataFrame(rows, "query_id int, segment_id string, rank int, score double")
    assert {r.query_id: r.faults for r in records.candidate_faults(ranked).collect()} == {2: "ranks", 3: "keys", 4: "scores"}
