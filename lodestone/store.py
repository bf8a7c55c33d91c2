"""A store of items on Parquet tables, with the calls of an evidence service: sync, query, trail, access, audit.

Tables are immutable snapshots: each change writes new folders and then the manifest with the next number, so a reader sees a
whole state or the one before. A number is taken once: a writer that finds its own taken begins anew from the state that the
other has left. Tables by source lie in buckets of sources, and a sync writes its source's bucket only. Logs grow by parts, which are
merged by the dozen as they become many, and so does the lexical index: a sync adds a part with its own
postings and lists what it took out of older ones.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identity as I
from .functions import text as X
from .index import GONE, Index, merge_parts, read_parts, tokenised, write_part
from .operators import audit, corpus, ireval, lifecycle, packing, passages, policy, pruned, trails, vectors, verify
from .tables import Scratch, put_if_absent

SCHEMAS = {
    "items": "source string, item string, text string, digest string, active boolean",
    "segments": "source string, item string, representation_id string, ordinal int, start long, stop long, text string, content_sha256 string, segment_id string",
    "access": "source string, seq long, time long, access string, actor string, leaf string",
    "states": "source string, seq long, state string, withdrawal string, leaf string",
    "gone": GONE,
    "embeddings": "space string, source string, segment_id string, content_sha256 string, values array<double>",
    "trails": "trail_id string, source string, mode string, policy string, query string, outcome string, budget long, used long, packet_id string, space string, values array<double>, "
    "candidates array<struct<segment_id:string,content_sha256:string,rank:bigint,bytes:bigint,selected:boolean,omission:string,duplicate_of:string,score:double,cosine:double,lexical_rank:bigint,vector_rank:bigint>>",
    # What trails tell of outlives the items: facts of all segments that ever were, and what they derive from.
    "facts": "segment_id string, representation_id string, start long, stop long, content_sha256 string",
    "derivations": "child string, parent string",
}
SEGMENTATION = ("fixed", "passage")
#: Tables dealt by source, by the first byte of its digest.
BUCKETED = ("items", "segments")
#: Parts of a log that become one.
MERGED = 12
#: Times that a change begins anew after another writer's.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer has published the next state."""


class Store:
    """All paths are those of Spark's file systems; nothing is read or written beside Spark."""

    def __init__(self, spark: SparkSession, root: str, segmentation: str = "fixed", _at: tuple[int, dict] | None = None) -> None:
        if segmentation not in SEGMENTATION:
            raise ValueError(f"segmentation is one of {SEGMENTATION}")
        self.spark, self.root, self.segmentation, self._at = spark, root.rstrip("/"), segmentation, _at

    # Snapshots.

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _latest(self) -> tuple[int, dict[str, list[dict]]]:
        """Number of the last manifest (0: none) and parts by table: place, bucket (null: not dealt), and how many parts of a log it was made of."""
        fs, path = self._fs()
        if not fs.exists(path):
            return 0, {}
        last = max((n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json")), default=None)
        return (int(last.removesuffix(".json")), json.loads(self.spark.read.text(f"{path}/{last}", wholetext=True).first()[0])) if last else (0, {})

    def _manifest(self) -> dict[str, list[dict]]:
        return self._at[1] if self._at else self._latest()[1]

    def _pinned(self) -> Store:
        """The store as it is now, also when others change it."""
        return Store(self.spark, self.root, self.segmentation, self._latest())

    def _changed(self, change: Callable[[Store], object]):
        """Runs ``change`` on the store as it is now; again on what another writer has made of it meanwhile."""
        for _ in range(ATTEMPTS):
            try:
                return change(self._pinned())
            except Conflict:
                continue
        raise Conflict(f"other writers came first {ATTEMPTS} times")

    def _read(self, name: str, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{p['place']}" for p in parts]) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._manifest().get(name, []))

    def _bucket(self, name: str, source: str) -> DataFrame:
        """The rows of a dealt table that share the source's bucket, its own among them."""
        bucket = _bucket_of(source)
        return self._read(name, [p for p in self._manifest().get(name, []) if p["bucket"] == bucket])

    def _written(self, root: str, name: str, df: DataFrame) -> list[dict]:
        place = f"{name}/{uuid.uuid4().hex}"
        df = df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns)
        if name not in BUCKETED:
            df.write.parquet(f"{root}/{place}")
            return [{"place": place, "bucket": None, "weight": 1}]
        df.withColumn("bucket", F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 2)).write.partitionBy("bucket").parquet(f"{root}/{place}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{place}")
        found = sorted(s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory())
        return [{"place": f"{place}/{n}", "bucket": n.removeprefix("bucket="), "weight": 1} for n in found if n.startswith("bucket=")]

    def _replace(self, source: str | None = None, logs: dict[str, DataFrame] | None = None, index: tuple[DataFrame, DataFrame] | None = None, **tables: DataFrame) -> None:
        """New snapshots of tables, or of the source's bucket of them, rows of logs, and segments for the index and what is gone from it, visible all at once."""
        if self._at is None:
            return self._changed(lambda s: s._replace(source, logs, index, **tables))
        before = self._manifest()
        bucket = source and _bucket_of(source)
        stay = {name: [p for p in before.get(name, []) if bucket and p["bucket"] != bucket] for name in tables}
        made = {name: stay[name] + self._written(self.root, name, df) for name, df in tables.items()}
        made |= {name: self._grown(name, df) for name, df in (logs or {}).items()}
        self._publish(self.root, before | made | (self._indexed(*index) if index else {}))

    def _grown(self, name: str, df: DataFrame) -> list[dict]:
        """Parts of a log with further rows. MERGED parts of equal weight become one, so a row is written again a logarithm of times."""
        parts = self._manifest().get(name, []) + self._written(self.root, name, df)
        while len(parts) >= MERGED and len({p["weight"] for p in parts[-MERGED:]}) == 1:
            last = parts[-MERGED:]
            merged = self._written(self.root, name, self._read(name, last).coalesce(MERGED))
            parts = parts[:-MERGED] + [p | {"weight": sum(x["weight"] for x in last)} for p in merged]
        return parts

    def _indexed(self, segments: DataFrame, gone: DataFrame) -> dict[str, list[dict]]:
        """Parts of the index with one more, merged like those of logs: what was gone from merged parts is forgotten."""
        parts = list(self._manifest().get("index", []))
        gone_parts = self._grown("gone", gone)
        if not segments.isEmpty():
            place = f"index/{uuid.uuid4().hex}"
            write_part(tokenised(segments, "segment_id", "text", "source"), f"{self.root}/{place}")
            parts.append({"place": place, "bucket": None, "weight": 1})
        while len(parts) >= MERGED and len({p["weight"] for p in parts[-MERGED:]}) == 1:
            last, place = parts[-MERGED:], f"index/{uuid.uuid4().hex}"
            merge_parts(self.spark, [f"{self.root}/{p['place']}" for p in last], self._read("gone", gone_parts), f"{self.root}/{place}")
            names = [p["place"].rsplit("/", 1)[-1] for p in last]
            gone_parts = self._written(self.root, "gone", self._read("gone", gone_parts).where(~F.col("part").isin(names)))
            parts = parts[:-MERGED] + [{"place": place, "bucket": None, "weight": sum(x["weight"] for x in last)}]
        return {"index": parts, "gone": gone_parts}

    def index(self) -> Index:
        """The lexical index of the present segments."""
        manifest = self._manifest()
        return read_parts(self.spark, [f"{self.root}/{p['place']}" for p in manifest.get("index", [])], self._read("gone", manifest["gone"]) if manifest.get("gone") else None)

    def _publish(self, root: str, places: dict[str, list[dict]]) -> None:
        """As the manifest after the one that this change began with; a Conflict if there is one by now."""
        number = self._at[0] + 1 if root == self.root else 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        if not put_if_absent(self.spark, f"{root}/manifests/{number:020d}.json", json.dumps(places).encode()):
            raise Conflict(f"manifest {number} is taken")

    # Sync.

    def sync_snapshot(self, source: str, listing: DataFrame, resume: str | None = None) -> DataFrame:
        """listing: item, text. Items that it lacks are deleted. Gives item, action."""
        return self._changed(lambda s: s._sync(source, listing.select("item", "text", F.lit(False).alias("deleted")), True, resume))

    def sync_changes(self, source: str, changes: DataFrame, resume: str | None = None) -> DataFrame:
        """changes: item, text, deleted. Items that they lack stay."""
        return self._changed(lambda s: s._sync(source, changes.select("item", "text", "deleted"), False, resume))

    def _state(self, source: str):
        """The source's last state, or None."""
        return self.table("states").where(F.col("source") == source).orderBy(F.desc("seq")).limit(1).first()

    def _sync(self, source: str, given: DataFrame, snapshot: bool, resume: str | None) -> DataFrame:
        """A withdrawn source comes back only by a sync that names its current withdrawal; any other name is an error."""
        state = self._state(source)
        withdrawal = state.withdrawal if state and state.state == "withdrawn" else None
        if resume != withdrawal:
            raise ValueError(f"the source is withdrawn by {withdrawal!r}, the sync resumes {resume!r}" if withdrawal else "the sync resumes a source that isn't withdrawn")
        given = given.withColumn("source", F.lit(source)).withColumn("digest", I.content_digest(F.coalesce("text", F.lit(""))))
        current = self._bucket("items", source)
        mine = current.where(F.col("source") == source)
        decide = lifecycle.snapshot_actions if snapshot else lifecycle.changelog_actions
        actions = decide(mine, given.drop("deleted") if snapshot else given)
        written = given.join(actions.where(F.col("action").isin("added", "updated", "restored")), ["source", "item"], "left_semi")
        new = written.select("source", "item", "text", "digest", F.lit(True).alias("active"))
        gone = mine.join(actions.where("action = 'deleted'"), ["source", "item"], "left_semi").withColumn("active", F.lit(False))
        touched = actions.where(F.col("action").isin("added", "updated", "restored", "deleted"))
        items = current.join(touched.select("source", "item"), ["source", "item"], "left_anti").unionByName(new).unionByName(gone)
        before, changed = self._bucket("segments", source), touched.select("source", "item")
        work = Scratch(self.spark, "sync")
        fresh = work.stored(self._segmented(new), "segments")
        segments = before.join(changed, ["source", "item"], "left_anti").unionByName(fresh)
        # What the index loses: documents of this source's segments that go or come anew.
        index = self.index()
        lost = before.join(changed, ["source", "item"], "left_semi").select(F.col("segment_id").alias("key"))
        lost = index.without_gone(index.docs.where(F.col("scope") == source).join(lost, "key", "left_semi"))
        lost = lost.select("part", "doc", "n_tokens", F.array_distinct("tokens").alias("terms"))
        # Before the tables that they derive from are replaced.
        actions.select("item", "action").write.parquet(place := f"{self.root}/reports/{uuid.uuid4().hex}")
        states = {} if state and state.state == "active" else {"states": self._next_state(source, "active", None)}
        logs = states | {"facts": fresh, "derivations": self._derivations(new)}
        self._replace(source, logs=logs, index=(fresh, lost), **{"items": items, "segments": segments})
        work.close()
        return self.spark.read.parquet(place)

    def _next_state(self, source: str, state: str, withdrawal: str | None) -> DataFrame:
        seq = self.table("states").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        return _leafed(self.spark.createDataFrame([(source, seq, state, withdrawal)], "source string, seq long, state string, withdrawal string"))

    def _named(self, items: DataFrame) -> DataFrame:
        """source, item, body, and the ids of source, observation, artifact and representation of each item."""
        named = items.select("source", "item", X.normalized(F.coalesce("text", F.lit(""))).alias("body"), "digest")
        named = named.withColumn("_source", I.source_id("store", F.col("source")))
        named = named.withColumn("_observation", I.observation_id(F.col("_source"), I.observation_name(F.col("item"), F.col("digest"))))
        named = named.withColumn("_artifact", I.artifact_id(F.col("_observation"), "raw"))
        content = I.content_digest(F.col("body"))
        parameters = F.lit(corpus.EMPTY_DIGEST) if self.segmentation == "fixed" else F.sha2(F.lit(b'{"segmentation":"passage-1"}'), 256)
        rep = I.representation_id([("artifact", F.col("_artifact"))], "text-normalizer", "1", parameters, "text/plain; charset=utf-8", content)
        return named.withColumn("representation_id", rep)

    def _derivations(self, items: DataFrame) -> DataFrame:
        chain = ("representation_id", "_artifact", "_observation", "_source")
        pairs = F.array(*[F.struct(F.col(a).alias("child"), F.col(b).alias("parent")) for a, b in zip(chain, chain[1:], strict=False)])
        return self._named(items).select(F.inline(pairs)).distinct()

    def _segmented(self, items: DataFrame) -> DataFrame:
        ready = self._named(items).select("source", "item", "representation_id", "body")
        if self.segmentation == "passage":
            return corpus.addressed(passages.segment_passages(ready))
        return corpus.fixed_segments(ready.withColumn("content_sha256", F.lit("")))

    def status(self) -> DataFrame:
        """source, state, access, active items, segments."""
        counts = self.table("items").groupBy("source").agg(F.count_if("active").alias("n_items"))
        pieces = self.table("segments").groupBy("source").agg(F.count("*").alias("n_segments"))
        state = lifecycle.latest(self.table("states"), ["source"], "seq").select("source", "state")
        access = policy.current_access(self.table("access"), source="source").select("source", "access")
        return state.join(access, "source", "left").join(counts, "source", "left").join(pieces, "source", "left")

    # Access and withdrawal.

    def set_access(self, source: str, access: str, actor: str, now: int | None = None, only_if_unset: bool = False) -> bool:
        """Appends an event unless nothing would change; times of a source always rise."""
        if access not in ("allow", "deny") or not (actor.isascii() and actor.isprintable()) or not 0 < len(actor) <= 256:
            raise ValueError("access is allow or deny, the actor printable ASCII")
        return self._changed(lambda s: s._set_access(source, access, actor, now, only_if_unset))

    def _set_access(self, source: str, access: str, actor: str, now: int | None, only_if_unset: bool) -> bool:
        log = self.table("access")
        last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        mine = log.where(F.col("source") == source).orderBy(F.desc("seq")).limit(1).first()
        if mine and (only_if_unset or mine.access == access):
            return False
        at = max(now if now is not None else time.time_ns() // 1000, mine.time + 1 if mine else 0)
        self._replace(logs={"access": _leafed(self.spark.createDataFrame([(source, last + 1, at, access, actor)], "source string, seq long, time long, access string, actor string"))})
        return True

    def withdraw(self, source: str, withdrawal: str) -> None:
        """Nothing changes if that withdrawal is current; another one of a withdrawn source is an error."""
        if not withdrawal:
            raise ValueError("a withdrawal has a name")
        self._changed(lambda s: s._withdraw(source, withdrawal))

    def _withdraw(self, source: str, withdrawal: str) -> None:
        state = self._state(source)
        if state and state.state == "withdrawn":
            if state.withdrawal != withdrawal:
                raise ValueError(f"the source is withdrawn by {state.withdrawal!r}")
            return
        self._replace(logs={"states": self._next_state(source, "withdrawn", withdrawal)})

    def decision(self, source: str) -> tuple[str, list[str]]:
        """outcome and reasons."""
        states = lifecycle.latest(self.table("states"), ["source"], "seq")
        row = policy.outcomes(self.spark.createDataFrame([(source,)], "source string"), states, policy.current_access(self.table("access"), source="source"), source="source").first()
        return row.outcome, list(row.reasons)

    # Queries.

    def query(self, source: str, text: str, budget: int = 8192, limit: int = 100, exact: bool = False) -> DataFrame:
        """rank, segment_id, item, start, stop, text, score, selected, omission; a trail is recorded."""
        _check_query(text, limit, budget)
        now = self._pinned()
        return now._answer(source, "lexical", text, now._lexical(source, text, limit), budget, exact)

    def _lexical(self, source: str, text: str, limit: int) -> DataFrame:
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        terms = asked.select("query_id", X.capped_terms(X.query_terms(F.col("text"))).alias("terms"))
        return pruned.best(self.index(), terms, limit, source)

    def vector_inputs(self, source: str) -> DataFrame:
        """What an embedding provider needs: current passages and their digests."""
        return self.table("segments").where(F.col("source") == source).select("source", "segment_id", "representation_id", "content_sha256", "text")

    def vector_import(self, space: str, imported: DataFrame) -> None:
        """imported: source, segment_id, content_sha256, values. Stale passages and changed values are errors; all or nothing."""
        self._changed(lambda s: s._vector_import(space, imported))

    def _vector_import(self, space: str, imported: DataFrame) -> None:
        rows = imported.withColumn("space", F.lit(space))
        stored = self.table("embeddings")
        if not vectors.stale_pins(rows, self.table("segments"), ["source", "segment_id", "content_sha256"]).isEmpty():
            raise ValueError("an imported vector belongs to no current passage")
        if not vectors.changed_vectors(rows, stored, ["space", "source", "segment_id"]).isEmpty():
            raise ValueError("a stored vector would change")
        fresh = rows.join(stored.select("space", "source", "segment_id"), ["space", "source", "segment_id"], "left_anti")
        self._replace(logs={"embeddings": fresh})

    def _near(self, source: str, space: str, values: list[float]) -> DataFrame:
        mine = self.table("embeddings").where((F.col("source") == source) & (F.col("space") == space))
        mine = mine.join(self.table("segments").select("segment_id", "content_sha256"), ["segment_id", "content_sha256"], "left_semi")
        asked = self.spark.createDataFrame([(0, [float(x) for x in values])], "query_id long, values array<double>")
        return vectors.exact_neighbours(mine, asked, key="segment_id")

    def vector_query(self, source: str, space: str, values: list[float], budget: int = 8192, limit: int = 100, exact: bool = False) -> DataFrame:
        _check_query(None, limit, budget)
        now = self._pinned()
        found = now._near(source, space, values).where(F.col("rank") <= limit).withColumn("cosine", F.col("score"))
        return now._answer(source, "vector", json.dumps(values), found, budget, exact, space, values)

    def hybrid_query(self, source: str, space: str, text: str, values: list[float], budget: int = 8192, limit: int = 100, exact: bool = False) -> DataFrame:
        _check_query(text, limit, budget)
        now = self._pinned()
        lex = now._lexical(source, text, limit)
        near = now._near(source, space, values)
        fused = vectors.fuse(lex, near, ["query_id", "segment_id"], "segment_id").join(near.select("segment_id", F.col("score").alias("cosine")), "segment_id", "left")
        return now._answer(source, "hybrid", text, fused, budget, exact, space, values)

    def _answer(self, source: str, mode: str, text: str, found: DataFrame, budget: int, exact: bool, space: str | None = None, values: list[float] | None = None) -> DataFrame:
        outcome, reasons = self.decision(source)
        if outcome == "deny":
            found = found.limit(0)
        about = self.table("segments").select("segment_id", "item", "start", "stop", "text", "content_sha256", (F.col("stop") - F.col("start")).alias("bytes"))
        for name, kind in (("cosine", "double"), ("lexical_rank", "long"), ("vector_rank", "long")):
            if name not in found.columns:
                found = found.withColumn(name, F.lit(None).cast(kind))
        full = found.join(about, "segment_id")
        packed = packing.gathered(full, "query_id", "segment_id", "item", "start", "stop", "text", "content_sha256", "bytes", "score", "cosine", "lexical_rank", "vector_rank")
        if exact:
            marks = packing.pack_distinct(F.col("candidates"), budget)["marks"]
        else:
            marks = F.transform(packing.pack(F.col("candidates"), budget)["flags"], lambda f: F.struct(f.alias("selected"), F.lit(None).cast("string").alias("omission"), F.lit(None).cast("string").alias("duplicate_of")))
        rows = packed.select(F.explode(F.arrays_zip("candidates", marks.alias("marks"))).alias("x")).select("x.candidates.*", "x.marks.*")
        rows.write.parquet(place := f"{self.root}/answers/{uuid.uuid4().hex}")
        rows = self.spark.read.schema(rows.schema).parquet(place)
        self._record(source, mode, text, outcome, reasons, rows, budget, verify.EXACT if exact else verify.ORIGINAL, space, values)
        return rows

    def _record(self, source: str, mode: str, text: str, outcome: str, reasons: list[str], rows: DataFrame, budget: int, packed_by: str, space: str | None, values: list[float] | None) -> None:
        fields = ("segment_id", "content_sha256", "rank", "bytes", "selected", "omission", "duplicate_of", "score", "cosine", "lexical_rank", "vector_rank")
        kept = F.when(F.col("selected"), F.struct("rank", "segment_id", "content_sha256", "bytes"))
        one = rows.agg(
            F.sort_array(F.collect_list(F.struct("rank", *[f for f in fields if f != "rank"]))).alias("c"),
            F.sort_array(F.collect_list(kept)).alias("k"),
            F.coalesce(F.sum(F.when(F.col("selected"), F.col("bytes"))), F.lit(0)).alias("used"),
        )
        active = "missing_state" not in reasons and "withdrawn" not in reasons
        n = F.size("k")
        result = policy.lexical_outcome(F.lit(outcome == "deny"), F.lit(active), n, F.size("c") - n, F.lit(0))
        trail = one.select(
            F.lit(source).alias("source"), F.lit(mode).alias("mode"), F.lit(packed_by).alias("policy"), F.lit(text).alias("query"), result.alias("outcome"), F.lit(budget).cast("long").alias("budget"), "used",
            I.packet_id(F.lit(budget), F.col("used"), F.col("k")).alias("packet_id"),
            F.lit(space).cast("string").alias("space"), (F.array(*[F.lit(float(v)) for v in values]) if values is not None else F.lit(None)).cast("array<double>").alias("values"),
            F.transform("c", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("candidates"),
        )
        # Ids are of content: the same answer to the same request is the same trail, however often it is recorded.
        request = I.tuple_hash(I.tag("request"), F.col("source"), F.col("mode"), F.col("query"))
        decision = I.tuple_hash(I.tag("decision"), I.raw(request), F.lit(outcome), *[F.lit(r) for r in reasons])
        shown = F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in ("segment_id", "content_sha256", "rank", "bytes", "selected")], F.lit("accepted").alias("disposition"), F.array_compact(F.array(c["omission"])).alias("reasons")))
        named = trail.withColumn("trail_id", trails.trail_id(I.tag("trail"), request, decision, F.col("outcome"), F.col("query"), F.col("budget"), F.col("used"), F.col("packet_id"), shown))
        self._changed(lambda s: s._replace(logs={"trails": named}))

    def trails(self) -> DataFrame:
        """Recorded trails, each once."""
        return self.table("trails").dropDuplicates(["trail_id"])

    def trail(self, source: str, trail_id: str) -> DataFrame:
        """Candidates of a trail of the source with whether they are still indexed; nothing at all if the source is denied."""
        allowed = self.decision(source)[0] == "allow"
        mine = self.trails().where((F.col("source") == source) & (F.col("trail_id") == trail_id) & F.lit(allowed))
        return trails.indexed_now(trails.exploded(mine), self.table("segments"))

    def trail_faults(self) -> DataFrame:
        """trail_id, position, check, fault: trails of any mode that disagree with themselves or with what the store holds. A sound store has none."""
        kept = self.trails()
        none = F.array().cast("array<string>")
        rows = trails.exploded(kept).select("*", F.lit("accepted").alias("disposition"), none.alias("reasons"))
        about = kept.select("trail_id", I.source_id("store", F.col("source")).alias("source"), (F.col("policy") == verify.EXACT).alias("exact"), "mode", "space", F.col("source").alias("_name"), "values")
        met = rows.join(about, "trail_id")
        told = kept.withColumn("candidates", F.transform("candidates", lambda c: F.struct(*[c[n].alias(n) for n in ("rank", "segment_id", "content_sha256", "bytes", "selected", "omission", "duplicate_of")], F.lit("accepted").alias("disposition"), none.alias("reasons"))))
        texts = self.table("segments").select("segment_id", "text").distinct()
        facts = self.table("facts").distinct().join(texts, "segment_id", "left")
        near = met.where("mode = 'vector' or (mode = 'hybrid' and vector_rank is not null)").withColumn("source", F.col("_name"))
        embedded = self.table("embeddings").select("space", "source", "segment_id", "content_sha256", "values")
        found = {
            "packing": verify.packing_faults(told),
            "content": verify.content_faults(met, facts, self.table("derivations").distinct()),
            "vector": verify.cosine_faults(near.drop("values"), kept.select("trail_id", "values"), embedded, ["space", "source", "segment_id"], ["content_sha256"]),
            "fusion": verify.fusion_faults(met.where("mode = 'hybrid'")),
        }
        every = [df.select("trail_id", "position", F.lit(name).alias("check"), "fault") for name, df in found.items()]
        return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])

    # Evaluation and audit.

    def evaluate(self, rankings: DataFrame, judgments: DataFrame) -> DataFrame:
        return ireval.macro(ireval.metrics(rankings, judgments), "ndcg_10", "recall_100", "mrr_10")

    def compare(self, left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        return ireval.compare(left, right, names)

    def audit(self) -> DataFrame:
        """check, n_rows; a sound store has 0 everywhere."""
        items, segments = self.table("items"), self.table("segments")
        stored = segments.select("source", "item", "segment_id")
        derived = self._segmented(items.where("active").select("source", "item", "text", "digest")).select("source", "item", "segment_id")
        return audit.violations(
            {
                "coordinates": segments.where(~corpus.coordinates_hold(segments)),
                "digests": items.where("active").where(I.content_digest(F.coalesce("text", F.lit(""))) != F.col("digest")),
                "segments": audit.derived_differently(stored, derived),
                "access_times": policy.time_violations(self.table("access"), source="source"),
                "access_log": audit.sequence_gaps(self.table("access")),
                "state_log": audit.sequence_gaps(self.table("states")),
                "leaves": self._wrong_leaves(),
                "index": self._wrong_index(),
                "trails": self.trail_faults(),
            }
        )

    def _wrong_leaves(self) -> DataFrame:
        """Log rows whose leaf isn't that of their record."""
        logs = [self.table(name) for name in ("access", "states")]
        wrong = [log.where(~F.col("leaf").eqNullSafe(_leaf(log))).select("source", "seq") for log in logs]
        return wrong[0].unionByName(wrong[1])

    def _wrong_index(self) -> DataFrame:
        """Segments that the index has not exactly once, and documents of the index that are no segment."""
        index = self.index()
        held = index.without_gone(index.docs.select("part", "doc", F.col("key").alias("segment_id"))).groupBy("segment_id").agg(F.count("*").alias("n"))
        return self.table("segments").select("segment_id", F.lit(1).alias("s")).join(held, "segment_id", "full").where("s is null or n is null or n <> 1")

    def backup(self, destination: str) -> None:
        """A copy of the present snapshot, refused if the destination exists, verified by reading it."""
        destination = destination.rstrip("/")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(destination)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise ValueError("the destination exists")
        manifest = self._manifest()
        copied = {name: self._written(destination, name, self._read(name, parts)) for name, parts in manifest.items() if name not in ("index", "gone")}
        if manifest.get("index"):
            merge_parts(self.spark, [f"{self.root}/{p['place']}" for p in manifest["index"]], self._read("gone", manifest.get("gone", [])), f"{destination}/{(place := f'index/{uuid.uuid4().hex}')}")
            copied["index"] = [{"place": place, "bucket": None, "weight": 1}]
        self._publish(destination, copied)
        if not Store(self.spark, destination, self.segmentation).audit().where("n_rows > 0").isEmpty():
            raise ValueError("the copy fails its audit")


def _bucket_of(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()[:2]


def _leaf(log: DataFrame):
    record = F.to_json(F.struct(*sorted(c for c in log.columns if c != "leaf")), {"ignoreNullFields": "false"})
    return I.log_leaf(record)


def _leafed(rows: DataFrame) -> DataFrame:
    """Rows of a log with the hash of their record."""
    return rows.withColumn("leaf", _leaf(rows))


def _check_query(text: str | None, limit: int, budget: int) -> None:
    if (text is not None and (not 0 < len(text.encode()) <= 4096 or "\0" in text)) or not 1 <= limit <= 100:
        raise ValueError("a query has 1 to 4096 bytes without NUL, the limit is 1 to 100")
    if budget < 1:
        raise ValueError("a budget has at least one byte")
