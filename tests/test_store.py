from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from lodestone import tables
from lodestone.operators import lexical
from lodestone.sources import directory
from lodestone.store import Conflict, Store
from pyspark.sql import functions as F


@pytest.fixture(params=["fixed", "passage"])
def store(spark, tmp_path, request):
    return Store(spark, str(tmp_path / "store"), request.param)


def listing(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "item string, text string")


def test_a_life(spark, store, tmp_path):
    texts = dict(a="The water runs.\n\n" * 3, b="Rivers and water. " * 400, c="Nothing here.")
    assert {r["item"]: r["action"] for r in store.sync_snapshot("s", listing(spark, **texts)).collect()} == dict.fromkeys("abc", "added")
    assert store.query("s", "water").count() == 0  # no access yet
    assert store.set_access("s", "allow", "me", now=10)
    assert not store.set_access("s", "allow", "me", now=11)
    got = store.query("s", "water", budget=5000).collect()
    assert {r["item"] for r in got} == {"a", "b"}
    assert sum(r.bytes for r in got if r.selected) <= 5000
    assert {r.outcome for r in store.table("trails").collect()} == {"policy_excluded", "evidence"}
    actions = store.sync_changes("s", spark.createDataFrame([("a", None, True), ("c", "Nothing here.", False), ("d", "More water", False)], "item string, text string, deleted boolean"))
    assert {r["item"]: r["action"] for r in actions.collect()} == {"a": "deleted", "c": "unchanged", "d": "added"}
    kept = store.table("trails").where("outcome = 'evidence'").first()
    seen = {r.segment_id: r.indexed_now for r in store.trail("s", kept.trail_id).collect()}
    assert set(seen.values()) == {True, False}
    assert store.audit().where("n_rows > 0").count() == 0
    store.withdraw("s", "w1")
    assert store.decision("s") == ("deny", ["withdrawn"])
    assert store.trail("s", kept.trail_id).count() == 0
    store.backup(str(tmp_path / "copy"))
    with pytest.raises(ValueError, match="exists"):
        store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy"), store.segmentation).table("items").count() == 4


def test_vectors(spark, store):
    store.sync_snapshot("s", listing(spark, a="one two", b="three four", c="five"))
    store.set_access("s", "allow", "me")
    inputs = store.vector_inputs("s").orderBy("text").collect()
    rows = [(r.source, r.segment_id, r.content_sha256, [float(i), 1.0]) for i, r in enumerate(inputs)]
    made = spark.createDataFrame(rows, "source string, segment_id string, content_sha256 string, values array<double>")
    store.vector_import("v", made)
    store.vector_import("v", made)
    assert store.table("embeddings").count() == 3
    with pytest.raises(ValueError, match="would change"):
        store.vector_import("v", made.withColumn("values", F.reverse("values")))
    with pytest.raises(ValueError, match="no current passage"):
        store.vector_import("v", made.withColumn("content_sha256", F.lit("0" * 64)))
    assert [r.text for r in sorted(store.vector_query("s", "v", [1.0, 0.0]).collect(), key=lambda r: r["rank"])] == [r.text for r in reversed(inputs)]
    best = min(store.hybrid_query("s", "v", "five", [0.0, 1.0]).collect(), key=lambda r: r["rank"])
    assert best.text == "five"


def test_a_withdrawn_source_stays_so(spark, store):
    one = listing(spark, a="one two")
    with pytest.raises(ValueError, match="isn't withdrawn"):
        store.sync_snapshot("s", one, resume="w1")
    store.sync_snapshot("s", one)
    store.sync_snapshot("t", listing(spark, a="three"))
    store.withdraw("s", "w1")
    store.withdraw("s", "w1")
    for other in (None, "w2"):
        with pytest.raises(ValueError, match="withdrawn by 'w1'"):
            store.sync_snapshot("s", one, resume=other)
    with pytest.raises(ValueError, match="withdrawn by 'w1'"):
        store.withdraw("s", "w2")
    store.sync_snapshot("s", one, resume="w1")
    assert [(r.source, r.state) for r in store.table("states").orderBy("seq").collect()] == [("s", "active"), ("t", "active"), ("s", "withdrawn"), ("s", "active")]
    assert store.table("items").count() == 2
    assert store.audit().where("n_rows > 0").count() == 0


def test_logs_grow_by_parts(spark, store, monkeypatch):
    monkeypatch.setattr("lodestone.store.MERGED", 3)
    for i in range(7):
        assert store.set_access("s", ("allow", "deny")[i % 2], "me", now=i)
    assert [p["weight"] for p in store._manifest()["access"]] == [3, 3, 1]
    assert sorted(r.seq for r in store.table("access").collect()) == list(range(1, 8))


def test_equal_trails_have_one_id(spark, store):
    store.sync_snapshot("s", listing(spark, a="one two"))
    store.set_access("s", "allow", "me")
    for text in ("one", "one", "two"):
        store.query("s", text)
    assert (store.table("trails").count(), store.trails().count()) == (3, 2)
    with pytest.raises(ValueError, match="budget"):
        store.query("s", "one", budget=0)
    for bad in ("", "a\0", "a" * 4097):
        with pytest.raises(ValueError, match="4096"):
            store.hybrid_query("s", "v", bad, [1.0])


def plain_ranking(spark, store, source, text):
    """By an index of all present segments made for the occasion."""
    rows = store.table("segments")
    posted = lexical.postings(rows)
    scored = lexical.scores(spark.createDataFrame([(0, text.split())], "query_id long, terms array<string>"), posted, lexical.lengths(rows))
    return [(r.segment_id, r.score) for r in lexical.ranked(scored.join(rows.where(F.col("source") == source), "segment_id", "left_semi")).orderBy("rank").collect()]


def test_the_index_grows_and_forgets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.store.MERGED", 4)
    store = Store(spark, str(tmp_path / "store"))
    store.set_access("s", "allow", "me")
    texts = {f"i{i}": f"water {'river ' * (i % 3)} word{i} stone" for i in range(9)}
    store.sync_snapshot("s", listing(spark, **texts))
    parts = []
    for i in range(3):
        parts.append([p["place"] for p in store._manifest()["index"]])
        texts[f"i{i}"] = f"water again {i} river"
        texts.pop(f"i{i + 4}")
        store.sync_snapshot("s", listing(spark, **texts))
        store.sync_snapshot("t", listing(spark, a=f"water in another source {i}"))
        got = [(r.segment_id, r.score) for r in store.query("s", "water river stone again").orderBy("rank").collect()]
        assert got == plain_ranking(spark, store, "s", "water river stone again")
    # A sync leaves older parts as they are, but for those that were merged; a part has its own postings only.
    assert parts[1][:1] == parts[0] and len(parts[1]) == 3
    assert [p["weight"] for p in store._manifest()["index"]] == [4, 1, 1, 1]
    index = store.index()
    names = {p["place"].rsplit("/", 1)[-1] for p in store._manifest()["index"]}
    assert {r.part for r in store.table("gone").select("part").collect()} <= names
    assert index.statistics().first().n_rows == store.table("segments").count() == 7
    assert store.audit().where("n_rows > 0").count() == 0
    store.backup(str(tmp_path / "copy"))
    copy = Store(spark, str(tmp_path / "copy"))
    assert [(r.segment_id, r.score) for r in copy.query("s", "water river stone again").orderBy("rank").collect()] == got


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    Store(spark, root).set_access("x", "allow", "me")

    def write(who: int) -> None:
        store = Store(spark, root)
        for i in range(3):
            store.set_access(f"s{who}-{i}", "allow", "me")
        store.sync_snapshot(f"s{who}", listing(spark, a=f"text of {who}"))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    store = Store(spark, root)
    assert sorted(r.seq for r in store.table("access").collect()) == list(range(1, 11))
    assert {r.source for r in store.table("items").collect()} == {"s0", "s1", "s2"}
    assert store.index().statistics().first().n_rows == 3
    assert store.audit().where("n_rows > 0").count() == 0
    taken = store._pinned()
    store.set_access("y", "allow", "me")
    with pytest.raises(Conflict):
        taken._replace(logs={"access": taken.table("access")})


def test_trails_are_held_against_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.sync_snapshot("s", listing(spark, a="river water", b="river water", c="stone water river", d="dry"))
    store.set_access("s", "allow", "me")
    inputs = store.vector_inputs("s").collect()
    rows = [(r.source, r.segment_id, r.content_sha256, [0.1 * i, 1.0, 0.3]) for i, r in enumerate(inputs)]
    store.vector_import("v", spark.createDataFrame(rows, "source string, segment_id string, content_sha256 string, values array<double>"))
    store.query("s", "river water", budget=20, exact=True)
    store.query("s", "river water", budget=20)
    store.vector_query("s", "v", [1.0, 0.7, 0.1])
    store.hybrid_query("s", "v", "river", [1.0, 0.7, 0.1], exact=True)
    # Items that are gone leave their facts.
    store.sync_snapshot("s", listing(spark, c="stone water river", d="dry"))
    assert store.trail_faults().count() == 0 and store.audit().where("n_rows > 0").count() == 0
    kept = store.table("trails")

    def faults(**changes):
        """Of the trails with fields of their first candidate changed."""
        first = F.transform("candidates", lambda c, i: F.when(i == 0, F.struct(*[(changes.get(n) or (lambda c, n=n: c[n]))(c).alias(n) for n in kept.schema["candidates"].dataType.elementType.names])).otherwise(c))
        store._replace(trails=kept.withColumn("candidates", first))
        return {(r.mode, r.check, r.fault) for r in store.trail_faults().join(kept.select("trail_id", "mode"), "trail_id").collect()}

    every = ("lexical", "vector", "hybrid")
    assert faults(content_sha256=lambda c: F.sha2(F.lit("x"), 256)) >= {(m, "content", "digest") for m in every} | {(m, "packing", "packet") for m in every} | {("vector", "vector", "pins")}
    assert faults(cosine=lambda c: c["cosine"] * (1 + 2.0**-52)) == {("vector", "vector", "cosine"), ("hybrid", "vector", "cosine")}
    assert faults(score=lambda c: c["score"] + 1.0) == {("hybrid", "fusion", "fused")}
    assert {(m, "packing", "rank") for m in every} <= faults(rank=lambda c: c["rank"] + 1)
    assert {("lexical", "packing", "selected"), ("vector", "packing", "used")} <= faults(selected=lambda c: ~c["selected"])
    store._replace(trails=kept, derivations=store.table("derivations").where("false"))
    assert {(r.check, r.fault) for r in store.trail_faults().select("check", "fault").distinct().collect()} == {("content", "ancestry")}


def test_put_if_absent(spark, tmp_path):
    path = f"{tmp_path}/x"
    assert tables.put_if_absent(spark, path, b"one") and not tables.put_if_absent(spark, path, b"two")
    assert (tmp_path / "x").read_bytes() == b"one" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x"]


def test_a_changed_log_row_shows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(3):
        store.set_access("s", ("allow", "deny")[i % 2], "me", now=i + 1)
    store._replace(access=store.table("access").withColumn("actor", F.when(F.col("seq") == 2, "you").otherwise(F.col("actor"))))
    assert {(r.check, r.n_rows) for r in store.audit().where("n_rows > 0").collect()} == {("leaves", 1)}


def test_an_audit_sees_tampering(spark, store):
    store.sync_snapshot("s", listing(spark, a="one two", b="three"))
    store._replace(segments=store.table("segments").withColumn("text", F.upper("text")))
    assert {r.check for r in store.audit().where("n_rows > 0").collect()} == {"coordinates"}


def test_a_directory(spark, tmp_path):
    for name, text in {"a.md": "x", "sub/b.txt": "y", ".hidden.md": "h", "build/c.md": "g", "d.bin": "n", ".git/e.md": "v"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    files = directory.scan(spark, str(tmp_path))
    assert {r.path: r.reason for r in files.select("path", "reason").collect()} == {"a.md": None, "sub/b.txt": None, "build/c.md": "generated_directory", "d.bin": "not_included"}
    reasons = spark.createDataFrame([(".git/x.md",), ("a/.b/c.md",), ("k.md",)], "path string").select("path", directory.exclusion(F.col("path"), exclude=("k*",)).alias("r"))
    assert {r.path: r.r for r in reasons.collect()} == {".git/x.md": "git_metadata", "a/.b/c.md": "hidden", "k.md": "explicit_exclude"}
    assert sorted((r["item"], r.text) for r in directory.select(files).collect()) == [("a.md", "x"), ("sub/b.txt", "y")]
    with pytest.raises(Exception, match="too many bytes"):
        directory.select(files, total_bytes=1).collect()
    assert directory.preview(files).where("verdict = 'selected'").count() == 2
