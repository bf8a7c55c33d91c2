"""Stored trails held against what they tell of: their own packing, the records and texts they name, the vectors they were ranked by.

A trail is of one of three modes (lexical, vector, hybrid), which packing and content are checked for alike. Checks are set-based over all trails at
once and name each fault; a sound store has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions import vectors as V
from . import lineage, packing

EXACT, ORIGINAL = "exact-v1", "original"
_FAULTS = "array<struct<position:bigint,fault:string>>"


def _named(position: Column, *checks: tuple[str, Column]) -> Column:
    """Array of (position, fault) of the checks that hold."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), F.struct(position.cast("long").alias("position"), F.lit(name).alias("fault"))) for name, wrong in checks]))
    return found.cast(_FAULTS)


def _replayed(candidates: Column, budget: Column, exact: Column) -> Column:
    """Struct of what the fold over a trail's candidates has found: faults, and bytes used as recorded."""
    entry = "struct<selected:boolean,digest:string,bytes:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("used"), F.create_map().cast(f"map<string,{entry}>").alias("seen"), F.array().cast(_FAULTS).alias("faults"))

    def step(acc: Column, c: Column) -> Column:
        accepted = c["disposition"] == "accepted"
        marked = c["omission"].isNotNull() | c["duplicate_of"].isNotNull()
        reasons = F.coalesce(F.size(c["reasons"]), F.lit(0)) > 0
        known = F.map_contains_key(acc["seen"], c["segment_id"])
        twin = F.try_element_at(acc["seen"], c["duplicate_of"])
        fits = c["bytes"] <= budget - acc["used"]
        rank = acc["rank"] + accepted.cast("long")
        alike = F.coalesce(twin["selected"] & (twin["digest"] == c["content_sha256"]) & (twin["bytes"] == c["bytes"]), F.lit(False))
        packed = exact & accepted
        faults = _named(
            acc["position"] + 1,
            ("twice", known),
            ("rejected", ~accepted & (marked | ~reasons)),
            ("rank", accepted & ((c["rank"] != rank) | reasons)),
            ("selected", packed & c["selected"] & (marked | ~fits)),
            ("duplicate", packed & ~c["selected"] & (F.coalesce(c["omission"], F.lit("")) == "duplicate") & ~alike),
            ("budget", packed & ~c["selected"] & (F.coalesce(c["omission"], F.lit("")) == "budget") & (c["duplicate_of"].isNotNull() | fits)),
            ("omission", (packed & ~c["selected"] & ~F.coalesce(c["omission"].isin("duplicate", "budget"), F.lit(False))) | (~exact & marked)),
        )
        fact = F.struct(c["selected"].alias("selected"), c["content_sha256"].alias("digest"), c["bytes"].cast("long").alias("bytes")).cast(entry)
        return F.struct(
            (acc["position"] + 1).alias("position"),
            rank.alias("rank"),
            (acc["used"] + F.when(accepted & c["selected"], c["bytes"]).otherwise(0)).cast("long").alias("used"),
            F.when(known, acc["seen"]).otherwise(F.map_concat(acc["seen"], F.create_map(c["segment_id"], fact))).alias("seen"),
            F.concat(acc["faults"], faults).alias("faults"),
        )

    return F.aggregate(candidates, start, step)


def packing_faults(trails: DataFrame, trail_id: str = "trail_id") -> DataFrame:
    """trail_id, position, fault: what a trail asserts of ranks and packing and can't be so. Position 0 is the trail as a whole.

    trails: trail_id, policy, outcome, budget, used, packet_id, candidates (rank, segment_id, content_sha256, bytes, disposition, selected, omission,
    duplicate_of, reasons). By exact-v1 a text equal to a selected one is its duplicate, whether or not it would fit, and others are selected or
    don't fit. By the original policy the selection is what first fit gives, without omissions. Ids of packets are made again.
    """
    exact, accepted = F.col("policy") == EXACT, F.filter("candidates", lambda c: c["disposition"] == "accepted")
    seen = trails.withColumn("_fold", _replayed(F.col("candidates"), F.col("budget"), exact)).withColumn("_flags", packing.pack(accepted, F.col("budget"))["flags"])
    greedy = F.transform(F.arrays_zip(accepted.alias("c"), F.col("_flags").alias("f")), lambda p: F.when(p["c"]["selected"] != p["f"], F.struct(p["c"]["rank"].cast("long").alias("position"), F.lit("selected").alias("fault"))))
    chosen = F.transform(F.filter(accepted, lambda c: c["selected"]), lambda c: F.struct(c["rank"].cast("long").alias("rank"), c["segment_id"].alias("segment_id"), c["content_sha256"].alias("content_sha256"), c["bytes"].cast("long").alias("bytes")))
    whole = _named(
        F.lit(0),
        ("policy", ~F.col("policy").isin(EXACT, ORIGINAL)),
        ("denied", (F.col("outcome") == "policy_excluded") & (F.size("candidates") > 0)),
        ("no_budget", F.col("budget") < 1),
        ("used", F.col("used") != F.col("_fold.used")),
        ("packet", F.col("packet_id") != I.packet_id(F.col("budget"), F.col("used"), chosen)),
    )
    every = F.concat(whole, F.col("_fold.faults"), F.when(exact, F.array().cast(_FAULTS)).otherwise(F.array_compact(greedy).cast(_FAULTS)))
    return seen.select(trail_id, F.inline(every))


def content_faults(rows: DataFrame, segments: DataFrame, edges: DataFrame, trail_id: str = "trail_id") -> DataFrame:
    """trail_id, position, fault: candidates that disagree with the records and texts they name.

    rows: trail_id, position, source (id that the trail was decided for), exact (boolean), segment_id, content_sha256, bytes, disposition, selected, duplicate_of.
    segments: segment_id, representation_id, start, stop, content_sha256, text (null: no longer kept; then digest and range stay checkable).
    edges: derivations (child, parent) from representations up to sources, which are walked once for each representation.
    """
    about = segments.select("segment_id", "representation_id", (F.col("stop") - F.col("start")).alias("_size"), F.col("content_sha256").alias("_digest"), F.col("text").alias("_text"), F.lit(True).alias("_known"))
    met = rows.join(about, "segment_id", "left")
    named = met.where("representation_id is not null").select(F.col("representation_id").alias("leaf"), "source").distinct()
    tops = lineage.origins(named.select("leaf").distinct(), edges)
    derived = named.join(tops, "leaf").where("origin = source").select(F.col("leaf").alias("representation_id"), "source", F.lit(True).alias("_derives")).distinct()
    met = met.join(derived, ["representation_id", "source"], "left")
    accepted, known, kept = F.col("disposition") == "accepted", F.col("_known").isNotNull(), F.col("_text").isNotNull()
    # The first selected candidate of the same digest and bytes before this one.
    before = Window.partitionBy(trail_id, "content_sha256", "_text").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    retained = F.when(accepted & F.col("selected") & kept, F.col("segment_id"))
    met = met.withColumn("_twin", F.first(retained, ignorenulls=True).over(before))
    checks = (
        ("missing", ~known),
        ("digest", known & (F.col("_digest") != F.col("content_sha256"))),
        ("size", known & accepted & (F.col("_size") != F.col("bytes"))),
        ("ancestry", known & accepted & F.col("_derives").isNull()),
        ("text", kept & accepted & ((F.octet_length("_text") != F.col("_size")) | (I.content_digest(F.col("_text")) != F.col("_digest")))),
        ("duplicate", kept & accepted & F.col("exact") & ~F.col("duplicate_of").eqNullSafe(F.col("_twin"))),
    )
    return met.select(trail_id, F.inline(_named(F.col("position"), *checks)))


def cosine_faults(rows: DataFrame, queries: DataFrame, embeddings: DataFrame, on: list[str], pins: list[str], trail_id: str = "trail_id") -> DataFrame:
    """trail_id, position, fault: vector candidates without an embedding, with other pins than it has, or with another cosine than its values give, to the bit.

    rows: trail_id, position, ``on``, ``pins``, cosine. queries: trail_id, values. embeddings: ``on``, ``pins``, values.
    """
    held = embeddings.select(*on, *[F.col(p).alias(f"_{p}") for p in pins], F.col("values").alias("_v"), F.lit(True).alias("_known"))
    met = rows.join(held, on, "left").join(queries.select(trail_id, F.col("values").alias("_q")), trail_id, "left")
    same = F.coalesce(V.valid(F.col("_q")) & V.valid(F.col("_v")) & (F.size("_q") == F.size("_v")), F.lit(False))
    again = F.when(same, V.cosine(F.col("_v"), F.col("_q")))
    known = F.col("_known").isNotNull()
    differs = F.lit(False)
    for p in pins:
        differs = differs | ~F.col(p).eqNullSafe(F.col(f"_{p}"))
    checks = (("missing", ~known), ("pins", known & differs), ("cosine", known & ~again.eqNullSafe(F.col("cosine"))))
    return met.select(trail_id, F.inline(_named(F.col("position"), *checks)))


def fusion_faults(rows: DataFrame, key: str = "segment_id", trail_id: str = "trail_id") -> DataFrame:
    """trail_id, position, fault: hybrid candidates (position, key, lexical_rank, vector_rank, score) whose score isn't that of their ranks, to the bit, whose place isn't that of their score, or whose ranks another one has too."""
    order = Window.partitionBy(trail_id).orderBy(F.desc("score"), key)
    at = rows.withColumn("_place", F.row_number().over(order))
    for side in ("lexical_rank", "vector_rank"):
        at = at.withColumn(f"_n_{side}", F.count("*").over(Window.partitionBy(trail_id, side)))
    twice = lambda side: F.col(side).isNotNull() & (F.col(f"_n_{side}") > 1)
    checks = (
        ("fused", F.col("score") != V.fused(F.col("lexical_rank"), F.col("vector_rank"))),
        ("order", F.col("position") != F.col("_place")),
        ("unranked", F.col("lexical_rank").isNull() & F.col("vector_rank").isNull()),
        ("rank_twice", twice("lexical_rank") | twice("vector_rank")),
    )
    return at.select(trail_id, F.inline(_named(F.col("position"), *checks)))
