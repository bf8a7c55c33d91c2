"""Ancestry over a derivation graph given as edges (child, parent).

Reach is found by rounds: the nodes that the last round reached for the first time meet the edges, and what was reached before goes. Each
round is a stored table, so a node that many paths lead to is met once, and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch

#: Rounds of a search, and paths of one leaf.
MAX_DEPTH = 4096
MAX_PATHS = 4096
#: Rounds whose tables become one.
MERGED = 16


def _reached(start: DataFrame, edges: DataFrame, here: str, there: str) -> DataFrame:
    """``start`` (root, node) and all that its nodes lead to along ``edges`` from ``here`` to ``there``, each pair once; cycles end too."""
    work = Scratch(start.sparkSession, "reach")
    edges = work.stored(edges.where(F.col(here).isNotNull() & F.col(there).isNotNull()).select(F.col(here).alias("node"), F.col(there).alias("next")).distinct(), "edges")
    tables = [work.stored(start.where("node is not null").distinct(), "round0")]
    frontier = tables[0]
    for turn in range(1, MAX_DEPTH + 1):
        known = tables[0]
        for t in tables[1:]:
            known = known.unionByName(t)
        met = frontier.join(edges, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = work.stored(met.join(known, ["root", "node"], "left_anti"), f"round{turn}")
        if frontier.isEmpty():
            return known
        tables.append(frontier)
        if len(tables) == MERGED:
            tables = [work.stored(known.unionByName(frontier), f"upto{turn}")]
    raise ValueError(f"ancestry is deeper than {MAX_DEPTH}")


def descendants(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node): all that derives from each root, the root included, each pair once."""
    return _reached(roots.select("root", F.col("root").alias("node")), edges, "parent", "child")


def origins(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """leaf, origin: the nodes without parents that each leaf derives from, itself if it has none, each pair once.

    Origins come down from the nodes without parents, round by round, as pairs (node, origin) that are new: a leaf meets the origins of its parents, not all
    that is above it, and what leaves share is worked out once.
    """
    work = Scratch(leaves.sparkSession, "origins")
    up = work.stored(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "edges")
    asked = work.stored(leaves.select(F.col("leaf").alias("node")).where("node is not null").distinct(), "leaves")
    parents = up.select(F.col("parent").alias("node"))
    # Nodes above others; leaves that are none of them get theirs in the last step, once.
    tops = work.stored(parents.distinct().join(up.select(F.col("child").alias("node")), "node", "left_anti").select("node", F.col("node").alias("origin")), "round0")
    inner = work.stored(up.join(parents.distinct().withColumnRenamed("node", "child"), "child", "left_semi"), "inner")
    tables, frontier = [tops], tops
    for turn in range(1, MAX_DEPTH + 1):
        known = tables[0]
        for t in tables[1:]:
            known = known.unionByName(t)
        met = frontier.join(inner.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node"), "origin").distinct()
        frontier = work.stored(met.join(known, ["node", "origin"], "left_anti"), f"round{turn}")
        if frontier.isEmpty():
            break
        tables.append(frontier)
        if len(tables) == MERGED:
            tables = [work.stored(known.unionByName(frontier), f"upto{turn}")]
    else:
        raise ValueError(f"ancestry is deeper than {MAX_DEPTH}")
    own = asked.join(up.select(F.col("child").alias("node")), "node", "left_anti").select(F.col("node").alias("leaf"), F.col("node").alias("origin"))
    above = asked.join(up, asked["node"] == up["child"]).select(F.col("child").alias("leaf"), F.col("parent").alias("node"))
    return own.unionByName(above.join(known, "node").select("leaf", "origin").distinct())


def evidence_paths(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """(leaf, path): every chain of ids from a leaf up to a node without parents. A cycle is an error, and so are over MAX_PATHS of one leaf."""
    work = Scratch(leaves.sparkSession, "paths")
    edges = work.stored(edges.select(F.col("child").alias("node"), "parent").distinct(), "edges")
    ends, rounds = [], work.stored(leaves.select("leaf", F.col("leaf").alias("node"), F.array("leaf").alias("path")).distinct(), "round0")
    for turn in range(1, MAX_DEPTH + 1):
        ends.append(rounds.join(edges, "node", "left_anti").select("leaf", "path"))
        step = F.when(F.array_contains("path", F.col("parent")), F.raise_error(F.lit("ancestry has a cycle")).cast("array<string>")).otherwise(F.array_append("path", F.col("parent")))
        rounds = work.stored(rounds.join(edges, "node").select("leaf", F.col("parent").alias("node"), step.alias("path")), f"round{turn}")
        # Open paths of a leaf never become fewer: each leads to an end.
        many = rounds.groupBy("leaf").count().where(F.col("count") > MAX_PATHS).first()
        if many:
            raise ValueError(f"over {MAX_PATHS} paths lead up from {many.leaf}")
        if rounds.isEmpty():
            break
    else:
        raise ValueError(f"ancestry is deeper than {MAX_DEPTH}")
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def single_origin(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """leaf, origin, problem: the one root of each leaf, ``not_found`` without one, ``integrity`` with several. ``found`` is of ``origins``."""
    roots = found.groupBy("leaf").agg(F.collect_set("origin").alias("_roots"))
    out = leaves.select("leaf").distinct().join(roots, "leaf", "left")
    n = F.coalesce(F.size("_roots"), F.lit(0))
    return out.select("leaf", F.when(n == 1, F.col("_roots")[0]).alias("origin"), F.when(n < 1, "not_found").when(n > 1, "integrity").alias("problem"))
