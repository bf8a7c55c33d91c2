from __future__ import annotations

import sqlite3

import pytest
from lodestone.operators import ireval, lexical, packing, policy, questions
from lodestone.operators import lifecycle as L
from lodestone.plans import search as S
from lodestone.sources import jsonl
from lodestone.streaming import ingest
from pyspark.sql import functions as F


def candidates(spark, rows):
    df = spark.createDataFrame([(1, i + 1, f"s{i}", d, n) for i, (d, n) in enumerate(rows)], "query_id long, rank long, segment_id string, content_sha256 string, bytes long")
    return packing.gathered(df, "query_id", "segment_id", "content_sha256", "bytes")


@pytest.mark.parametrize(("rows", "budget", "flags"), [([("a", 5), ("b", 9), ("c", 3)], 8, [True, False, True]), ([("a", 9)], 8, [False]), ([("a", 8), ("b", 1)], 8, [True, False])])
def test_pack_passes_over_what_does_not_fit(spark, rows, budget, flags):
    assert candidates(spark, rows).select(packing.pack(F.col("candidates"), budget)["flags"]).first()[0] == flags


def test_pack_distinct(spark):
    rows = [("a", 20), ("a", 20), ("b", 20), ("b", 5), ("c", 13)]
    marks = candidates(spark, rows).select(packing.pack_distinct(F.col("candidates"), 33)["marks"]).first()[0]
    assert [(m.selected, m.omission, m.duplicate_of) for m in marks] == [(True, None, None), (False, "duplicate", "s0"), (False, "budget", None), (True, None, None), (False, "budget", None)]


def test_bm25_equals_a_full_text_index(spark):
    docs = ["alpha beta café", "alpha gamma", "beta delta beta", "tieword", "tieword", "the zebra of the alpha"]
    segments = spark.createDataFrame([(f"{i}", t) for i, t in enumerate(docs)], "segment_id string, text string")
    queries = spark.createDataFrame([(1, "alpha beta cafe"), (2, "tieword"), (3, "the alpha alpha"), (4, "—")], "query_id long, text string")
    got = {(r.query_id, int(r.segment_id)): r.score for r in S.search(segments.withColumn("source", F.lit("s")), queries).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(docs)))
    expected = {(q, r): s for q, e in ((1, '"alpha" OR "beta" OR "cafe"'), (2, '"tieword"'), (3, '"the" OR "alpha" OR "alpha"')) for r, s in db.execute("select rowid, bm25(t) from t where t match ?", (e,))}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_phrases_need_adjacent_tokens(spark):
    posted = lexical.postings(spark.createDataFrame([("a", "it s here"), ("b", "it was s"), ("c", "It’s it’s")], "segment_id string, text string"))
    got = {r.segment_id: r.f for r in lexical.phrase_matches(posted, spark.createDataFrame([("it s",)], "phrase string")).collect()}
    assert got == {"a": 1, "c": 2}


def test_graded_gain_of_a_reversed_ranking(spark):
    from math import log2

    ranking = spark.createDataFrame([(1, "low", 1), (1, "high", 2), (1, "other", 3)], "query_id long, doc_id string, rank long")
    judged = spark.createDataFrame([(1, "low", 1), (1, "high", 2), (2, "x", 0)], "query_id long, doc_id string, gain int")
    got = {r.query_id: r for r in ireval.metrics(ranking, judged).collect()}
    assert got[1].ndcg_10 == pytest.approx((1 + 2 / log2(3)) / (2 + 1 / log2(3)))
    assert (got[1].recall_100, got[1].mrr_10) == (1.0, 1.0)
    assert (got[2].ndcg_10, got[2].recall_100, got[2].mrr_10) == (0.0, 0.0, 0.0)


def test_policy_reasons(spark):
    sources = spark.createDataFrame([(i,) for i in range(5)], "source_id long")
    states = spark.createDataFrame([(1, "active"), (2, "withdrawn"), (3, "active"), (4, "active")], "source_id long, state string")
    access = spark.createDataFrame([(1, "allow"), (2, "allow"), (3, "deny")], "source_id long, access string")
    got = {r.source_id: (r.reasons, r.outcome) for r in policy.outcomes(sources, states, access).collect()}
    assert got == {0: (["missing_state", "access_default"], "deny"), 1: ([], "allow"), 2: (["withdrawn"], "deny"), 3: (["access_denied"], "deny"), 4: (["access_default"], "deny")}


def test_item_actions(spark):
    current = spark.createDataFrame([("s", i, d, a) for i, d, a in (("kept", "1", True), ("new text", "1", True), ("gone", "1", False), ("left", "1", True), ("dead", "1", False))], "source string, item string, digest string, active boolean")
    incoming = spark.createDataFrame([("s", i, d, x) for i, d, x in (("kept", "1", False), ("new text", "2", False), ("gone", "1", False), ("first", "1", False), ("dead", None, True))], "source string, item string, digest string, deleted boolean")
    got = {r["item"]: r["action"] for r in L.changelog_actions(current, incoming).collect()}
    assert got == {"kept": "unchanged", "new text": "updated", "gone": "restored", "first": "added", "dead": "absent"}
    got = {r["item"]: r["action"] for r in L.snapshot_actions(current, incoming.where("not deleted").drop("deleted")).collect()}
    assert got == {"kept": "unchanged", "new text": "updated", "gone": "restored", "first": "added", "left": "deleted"}


@pytest.mark.parametrize(
    ("line", "problem"),
    [('{"id": "a", "text": "b"}', False), ('{"id": "a", "deleted": true}', False), ('{"id": "a", "id": "a", "text": ""}', True), ('{"id": "a"}', True), ('{"id": "a", "text": null}', True), ('{"id": "a", "text": "", "deleted": true}', True), ('{"id": "", "text": ""}', True), ('{"id": "a", "deleted": false}', True), ('{"id": "a", "text": "\\ud800"}', True), ('{"id": "a", "text": ""} x', True), ("[]", True), ("{", True)],
)
def test_strict_items(line, problem):
    assert (jsonl.decode_item(line)[3] is not None) == problem


def test_committed_prefix(spark):
    lines = ['{"id": "a", "text": "1"}', "", '{"id": "b", "deleted": true}', '{"id": "a", "text": "2"}', '{"id": "c", "text": "3"}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string")
    assert sorted(r["item"] for r in jsonl.committed(jsonl.decode_lines(df)).collect()) == ["a", "b"]


PUSHES = [(None, None, "unnumbered"), (5, None, "first"), (6, None, "next"), (3, None, "late"), (9, None, "invalid"), (9, (7, 9), "jump"), (10, (8, 9), "invalid"), (10, None, "next")]


def event(arrival: int, **more) -> dict:
    return dict.fromkeys(ingest.INPUT) | {"source": 1, "arrival": arrival, "kind": "push", "digest": "d"} | more


def test_sequence_automaton():
    s, receipts = ingest.Source(), {}
    for i, (n, gap, verdict) in enumerate(PUSHES):
        assert ingest.advance(s, event(i, sequence=n, gap_start=gap and gap[0], gap_stop=gap and gap[1]), receipts) == verdict
    assert s.high == 10
    assert ingest.advance(s, event(1, sequence=5), receipts) == "replay"
    assert ingest.advance(s, event(1, sequence=5, digest="other"), receipts) == "conflict"
    assert ingest.advance(s, event(20, kind="withdraw", withdrawal="w"), receipts) == "withdrawn"
    assert ingest.advance(s, event(21, sequence=11), receipts) == "withdrawn_source"
    assert ingest.advance(s, event(22, sequence=11, resume="w"), receipts) == "next"
    assert ingest.advance(s, event(23, kind="pull", expected="x", next="y"), receipts) == "conflict"
    assert ingest.advance(s, event(24, kind="pull", next="y"), receipts) == "pulled"
    assert ingest.advance(s, event(25, kind="pull", expected="y", next="z"), receipts) == "pulled"


def test_batch_verdicts_until_the_first_rejection(spark):
    rows = [(1, i, n, gap) for i, (n, gap, _) in enumerate(PUSHES)]
    df = spark.createDataFrame(rows, "source long, arrival long, sequence long, gap struct<start:long,stop:long>")
    got = [r.verdict for r in sorted(L.sequence_verdicts(df).collect(), key=lambda r: r.arrival)]
    assert got == ["unnumbered", "first", "next", "late", "invalid", "unknown", "unknown", "unknown"]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    for name, value in ingest.STATE_STORE.items():
        spark.conf.set(name, value)
    table = spark.createDataFrame([(i, i % 3, f"p{i % 5}") for i in range(1, 240)], "event_id long, user_id long, props string")
    events = ingest.events_of(table).cache()
    want = sorted(map(tuple, ingest.verdicts_in_batch(events).collect()))
    assert {w[2] for w in want} >= {"first", "next", "jump", "invalid", "late", "unnumbered", "replay", "pulled", "conflict", "withdrawn", "withdrawn_source"}

    def run() -> None:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ingest.verdicts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    # Deliveries that came twice come in other batches than the first time; the query ends and starts again between batches.
    once = events.dropDuplicates(["source", "arrival"])
    for k in range(2):
        once.where(f"arrival div 120 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    again = events.exceptAll(once)
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("source", "arrival", "verdict", "high").collect()]
    assert sorted((*g[:3], g[3]) for g in got if g[2] != "replay") == [w for w in want if w[2] != "replay"]
    assert sorted(g[:2] for g in got if g[2] == "replay") == [w[:2] for w in want if w[2] == "replay"]


def test_cover_by_several_ranges(spark):
    answers = spark.createDataFrame([(1, 0, p, "s", a, b, None) for p, a, b in (("whole", 0, 10), ("hole", 20, 40), ("none", 90, 95))], "question long, passage_group long, passage string, source string, start long, stop long, anchor string")
    results = spark.createDataFrame([(1, "s", 1, a, b, "") for a, b in ((0, 6), (5, 12), (18, 25), (30, 45))], "question long, source string, rank long, start long, stop long, text string")
    assert {r.passage: r.covered for r in questions.covers(results, answers).collect()} == {"whole": True, "hole": False, "none": False}
