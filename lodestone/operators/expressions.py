"""Full-text expressions: phrases, prefixes, AND, OR, NOT and parentheses, as sets of rows.

``"a b"`` is a phrase, ``gam*`` a prefix, words side by side mean AND. NOT binds before AND, AND before OR.
A parsed expression is a tree; each leaf is a set of keys, and the tree is semi joins, unions and anti joins of these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical

_PART = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([()])|([^\s()"*]+)(\*?))')


@dataclass(frozen=True)
class Leaf:
    """A phrase; ``prefix`` lets its last word go on."""

    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    operator: str  # AND, OR, NOT
    left: Node | Leaf
    right: Node | Leaf


def _parts(text: str) -> list[str | Leaf]:
    out: list[str | Leaf] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not an expression at {at}: {text!r}")
        at = m.end()
        quoted, quoted_star, bracket, word, star = m.groups()
        if quoted is not None:
            out.append(Leaf(quoted.replace('""', '"'), bool(quoted_star)))
        elif bracket or word in ("AND", "OR", "NOT"):
            out.append(bracket or word)
        else:
            out.append(Leaf(word, bool(star)))
    return out


def parse(text: str) -> Node | Leaf:
    """The tree of an expression; anything else is an error."""
    parts = _parts(text)
    levels = ("OR", "AND", "NOT")

    def read(level: int) -> Node | Leaf:
        if level == len(levels):
            part = parts.pop(0) if parts else None
            if part == "(":
                inner = read(0)
                if not parts or parts.pop(0) != ")":
                    raise ValueError(f"a bracket stays open: {text!r}")
                return inner
            if not isinstance(part, Leaf):
                raise ValueError(f"a word is missing: {text!r}")
            return part
        out = read(level + 1)
        while parts:
            beside = levels[level] == "AND" and (isinstance(parts[0], Leaf) or parts[0] == "(")
            if not beside and parts[0] != levels[level]:
                break
            if not beside:
                parts.pop(0)
            out = Node(levels[level], out, read(level + 1))
        return out

    tree = read(0)
    if parts:
        raise ValueError(f"not an expression: {text!r}")
    return tree


def matches(posted: DataFrame, tree: Node | Leaf, key: str = "segment_id") -> DataFrame:
    """Keys of the rows that the tree accepts. posted: key, term, position."""
    if isinstance(tree, Leaf):
        return _leaf(posted, tree, key)
    left, right = matches(posted, tree.left, key), matches(posted, tree.right, key)
    if tree.operator == "OR":
        return left.unionByName(right).distinct()
    return left.join(right, key, "left_semi" if tree.operator == "AND" else "left_anti")


def holds(tokens: Column, tree: Node | Leaf, spark: SparkSession) -> Column:
    """Whether the tree accepts a row of these tokens: ``matches`` where whole rows are at hand, so that nothing is joined."""
    if isinstance(tree, Node):
        left, right = holds(tokens, tree.left, spark), holds(tokens, tree.right, spark)
        return left | right if tree.operator == "OR" else left & right if tree.operator == "AND" else left & ~right
    words = _words(spark, tree)
    if not words:
        return F.lit(False)
    fits = lambda t, i: F.coalesce(t.startswith(words[i]) if tree.prefix and i == len(words) - 1 else t == words[i], F.lit(False))
    if len(words) == 1:
        return F.coalesce(F.exists(tokens, lambda t: fits(t, 0)), F.lit(False))
    runs = F.arrays_zip(*[F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1))).alias(f"w{i}") for i in range(len(words))])

    def all_fit(run: Column) -> Column:
        out = fits(run["w0"], 0)
        for i in range(1, len(words)):
            out = out & fits(run[f"w{i}"], i)
        return out

    return F.coalesce(F.exists(runs, all_fit), F.lit(False))


def _words(spark: SparkSession, leaf: Leaf) -> list[str]:
    return spark.range(1).select(X.tokens(F.lit(leaf.text)).alias("t")).first()["t"]  # one row


def _leaf(posted: DataFrame, leaf: Leaf, key: str) -> DataFrame:
    words = _words(posted.sparkSession, leaf)
    if not words:
        return posted.select(key).limit(0)
    places = None
    for i, word in enumerate(words):
        last = leaf.prefix and i == len(words) - 1
        hit = posted.where(F.col("term").startswith(word) if last else F.col("term") == word).select(key, (F.col("position") - i).alias("place"))
        places = hit if places is None else places.join(hit, [key, "place"], "left_semi")
    return places.select(key).distinct()


def floor_premise(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row on which terms weigh next to nothing: those that more than half of the rows hold. terms: term, df."""
    n = F.broadcast(lengths.agg(F.count("*").alias("n_rows")))  # one row
    rated = terms.crossJoin(n).withColumn("floored", (F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5) <= 1)
    idf = lexical.inverse_frequency(F.col("n_rows"), F.col("df"))
    return rated.agg(
        F.first("n_rows").alias("n_rows"),
        F.max("df").alias("largest_df"),
        F.count_if("floored").alias("n_floored"),
        F.min(F.when(F.col("floored"), F.col("df"))).alias("least_floored_df"),
        F.max(F.when(~F.col("floored"), F.col("df"))).alias("largest_df_above"),
        F.round(F.min(F.when(~F.col("floored"), idf)), 9).alias("weakest_above"),
    )
