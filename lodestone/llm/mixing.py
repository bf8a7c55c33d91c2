"""Mixing sources to target weights by budgets in a tree of domain, language and source.

The token budget goes down the tree by the weights of siblings. A node can take at
most what its documents give in ``max_epochs`` epochs; what it can't take goes to its
siblings in proportion to their weights, and only what all siblings together
can't take stays with the parent's own siblings, because a parent's capacity is
the sum of its children's. All shares are whole tokens, rounded down.

A leaf with t tokens and budget b takes every document in each of b // t full
epochs. In the epoch after those it takes, in the order of a seeded hash of epoch
and id, the longest prefix with at most b % t tokens. To keep that prefix sum apart from
the size of a leaf, tokens are summed by ranges of the hash first; only the range in which
the prefix ends is ordered.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Edge cases: a null or blank text has 0 tokens and
rides along wherever its place in the order is within the prefix, and in each full epoch;
a leaf without tokens gives nothing. Null languages and sources are nodes named "none";
a null id hashes as the empty string. Ties of the hash are ordered by id, tokens and text.
Texts of any length count whole. Repeated rows count each. Extra columns of any names pass through, but for ``domain``, ``n_tokens`` and
``epoch``, which the result's own replace; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, join_table, stored

LEVELS = ("_domain", "_lang", "_source")


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers; a name that is missing has the default weight."""

    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 50, "fr": 20, "de": 20, "es": 10})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 10
    #: Tokens to select, in hundredths of those there are.
    percent: int = 60
    max_epochs: int = 3
    seed: str = "mix-1"
    domains: int = 4


def domain_of(source: str, domains: int) -> Column:
    """The default tree puts a source into a domain by the number at its end."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("domain"), (number % domains).cast("string")), F.lit("none"))


def word_count(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def _weight(column: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (with cap, weight and the parent's budget) with ``share`` in place of ``budget``.

    Siblings in the order of cap / weight: those are full for which cap / weight is at
    most what is left for each unit of weight when all before them are full.
    """
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    units = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = nodes.withColumn("full", (F.col("weight") > 0) & (F.col("cap") * units <= F.col("weight") * left))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    return (
        full.withColumns({"_rest": rest, "_units": share})
        .withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("coalesce((weight * _rest) div nullif(_units, 0), 0)")).cast("long"))
        .drop("_rest", "_units", "full", "budget")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (the levels and ``tokens``) with ``budget`` in tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    budget = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.percent} div 100").alias("budget"))
    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)
    shares = None
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(name, weights[depth], mix.default_weight))
        # One row of totals, or the shares of the level above.
        nodes = nodes.crossJoin(F.broadcast(budget)) if shares is None else nodes.join(shares, path[:-1])
        shares = _fill(nodes, path[:-1], name).select(*path, F.col("share").alias("budget"))
    return leaves.select(*LEVELS, "tokens").join(shares, list(LEVELS))


def _order_hash(mix: Mix) -> Column:
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("_full").cast("string"), F.lit(":"), F.col("_id")).cast("binary"))


def mix_sources(df: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``df``, one for each epoch that selects them, with ``domain``, ``n_tokens`` and ``epoch``; of input columns of these names, the new ones are given."""
    keep = [F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("domain", "n_tokens", "epoch")]
    return _mixed(df, mix, doc_id, text, lang, source).select(*keep, F.col("_domain").alias("domain"), F.col("_tokens").alias("n_tokens"), "epoch")


def mixed_rows(df: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``df``, one for each epoch that selects them, with their own columns, whatever the names."""
    return _mixed(df, mix, doc_id, text, lang, source).select("_row.*")


def _mixed(df: DataFrame, mix: Mix, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    # The input's columns travel in a struct, so their names clash with nothing.
    rows = df.select(
        F.struct(*df.columns).alias("_row"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
        domain_of(source, mix.domains).alias("_domain"),
        F.coalesce(F.col(lang), F.lit("none")).alias("_lang"),
        F.coalesce(F.col(source), F.lit("none")).alias("_source"),
        word_count(text).alias("_tokens"),
    )
    slim = checkpointed(rows.select("_id", *LEVELS, "_tokens"))
    leaves = slim.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, mix).where("tokens > 0").selectExpr(*LEVELS, "cast(budget div tokens as int) as _full", "budget % tokens as _left")
    plan = stored(plan, "leaf-shares")
    spread = F.xxhash64("_id", "_tokens")
    ranges = (
        join_table(slim, plan, list(LEVELS), spread)
        .where("_left > 0")
        .groupBy(*LEVELS, "_left", F.substring(_order_hash(mix), 1, 3).alias("_range"))
        .agg(F.sum("_tokens").alias("_sum"))
        .withColumn("_upto", F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    )
    # The range in which the prefix ends: the first whose running sum is over the budget. It exists, as _left < tokens.
    ends = ranges.where("_upto > _left").groupBy(*LEVELS).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_end"))
    plan = stored(plan.join(ends, list(LEVELS), "left").select(*LEVELS, "_full", "_left", F.col("_end._range").alias("_range"), F.col("_end._before").alias("_before")), "leaf-plan")
    placed = join_table(rows, plan, list(LEVELS), spread).withColumn("_hash", _order_hash(mix))
    place = F.substring("_hash", 1, 3)
    tied = Window.partitionBy(*LEVELS).orderBy("_hash", F.col("_row").getField(doc_id), "_tokens", F.col("_row").getField(text)).rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(place == F.col("_range")).withColumn("_in", F.col("_before") + F.sum("_tokens").over(tied) <= F.col("_left"))
    sure = placed.where(F.col("_range").isNull() | (place != F.col("_range"))).withColumn("_in", F.coalesce(place < F.col("_range"), F.lit(False)))
    epochs = F.expr("if(_full + if(_in, 1, 0) > 0, sequence(0, _full + if(_in, 1, 0) - 1), cast(array() as array<int>))")
    return sure.unionByName(last).select("_row", "_domain", "_tokens", F.explode(epochs).alias("epoch"))
