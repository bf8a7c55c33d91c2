"""Faults that reviews of the third round found."""

from __future__ import annotations

import html
import re

import pytest
from lodestone.operators import blocks as B
from pyspark.sql import functions as F

B_WHITE = re.compile("[ \t\n\r\x0b\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
REFERENCES = ["&amp;&amp", "a &lt;b&gt; &eacute;&#233;&#xE9 &notit; &nosuch; &am;", "&&amp;amp; &", "plain", None, "&copy2; &#; &#x110000; &#128;"]


@pytest.mark.parametrize("closed", [False, True])
def test_references_are_resolved_whole_or_only_with_a_semicolon(spark, closed):
    rows = spark.createDataFrame(list(enumerate(REFERENCES)), "i int, t string")
    got = [r.p for r in rows.select("i", B.plain(F.col("t"), closed).alias("p")).orderBy("i").collect()]
    want = ["&&amp", "a <b> éé&#xE9 &notit; &nosuch; &am;", "&&amp; &", "plain", None, "&copy2; &#; � €"]
    assert got == (want if closed else [t and html.unescape(t) for t in REFERENCES])


def test_a_search_scans_rows_and_hands_on_only_the_best(spark, monkeypatch):
    """Against plain scores, with phrases of several tokens, repeats, ties, rows in small blocks and queries in several passes."""
    import random

    from lodestone.functions import text as X
    from lodestone.operators import lexical, scan
    from lodestone.plans import search as S

    monkeypatch.setattr(S, "index_of", None)  # no index is made
    monkeypatch.setattr(scan, "ROWS", 7)
    monkeypatch.setattr(scan, "QUERIES", 3)
    r = random.Random(3)
    words = ["alpha", "beta", "it’s", "the", "the", "the", "zebra", "Café"]
    segments = spark.createDataFrame([(f"s{i:03}", " ".join(r.choice(words) for _ in range(r.randint(0, 6))), f"src{i % 2}") for i in range(120)], "segment_id string, text string, source string").repartition(5)
    queries = spark.createDataFrame([(1, "alpha beta it’s"), (2, "the the zebra"), (3, "—"), (4, "cafe nothing it’s it’s"), (5, "the"), (6, "")], "query_id long, text string")
    terms = queries.select("query_id", X.query_terms(F.col("text")).alias("terms"))
    all_scores = lexical.scores(terms, lexical.postings(segments), lexical.lengths(segments))
    fewer = lexical.floor_reduced(terms, lexical.postings(segments), lexical.lengths(segments)).select("query_id", "terms")
    plain = {
        "all": lexical.ranked(all_scores, limit=11),
        "scope": lexical.ranked(all_scores.join(segments.where("source = 'src1'"), "segment_id", "left_semi"), limit=11),
        "floor": lexical.ranked(lexical.scores(fewer, lexical.postings(segments), lexical.lengths(segments)), limit=11),
    }
    got = {"all": S.search(segments, queries, 11), "scope": S.search(segments, queries, 11, source="src1"), "floor": S.search(segments, queries, 11, drop_floor=True)}
    for k, want in plain.items():
        columns = ["query_id", "segment_id", "score", "rank"]
        assert sorted(map(tuple, got[k].select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())), k


def test_terms_are_summed_within_tasks(spark):
    from lodestone.operators import lexical

    rows = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", ""), ("d", None)], "segment_id string, text string")
    assert sorted(map(tuple, lexical.text_statistics(rows).collect())) == sorted(map(tuple, lexical.term_statistics(lexical.postings(rows)).collect())) == [("x", 1, 2), ("y", 2, 2)]


def test_expressions_hold_row_by_row(spark):
    from lodestone.functions import text as X
    from lodestone.operators import expressions, lexical

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a b c", "b a", "c", "", None, "a bcd", "b c a b"])], "segment_id string, text string")
    for e in ("a b", '"a b"', "b*", '"a b"*', "(a OR c) NOT b", "a OR c AND b", '"—"', '"a b c d e f g h"'):
        tree = expressions.parse(e)
        got = rows.where(expressions.holds(X.tokens(F.col("text")), tree, spark)).select("segment_id")
        want = expressions.matches(lexical.postings(rows), tree)
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()), e


def test_origins_come_down_from_the_top(spark):
    import random

    from lodestone.operators import lineage

    r = random.Random(2)
    pairs = {(f"n{i}", f"n{r.randrange(i)}") for i in range(3, 60) for _ in range(r.randint(0, 2))} | {("n5", None), ("x", "y"), ("y", "x"), ("z", "x")}
    leaves = [f"n{i}" for i in range(0, 60, 2)] + ["z", "alone", "n50"]

    def tops(node, seen):
        up = [p for c, p in pairs if c == node and p]
        return {node} if not up else set().union(*[tops(p, seen | {node}) for p in up if p not in seen | {node}])

    got = lineage.origins(spark.createDataFrame([(x,) for x in leaves], "leaf string"), spark.createDataFrame(list(pairs), "child string, parent string"))
    assert sorted(map(tuple, got.collect())) == sorted({(x, t) for x in leaves for t in tops(x, frozenset())})


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_neighbours_of_large_blocks(spark, monkeypatch, held):
    import numpy as np
    from lodestone.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "HELD", held)
    x = np.random.default_rng(1).normal(size=(60, 4))
    x[40:] = x[:20]  # ties
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, values array<double>")
    asked = rows.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    all_pairs = vectors.exact_neighbours(rows, asked).select("query_id", "vec_id", "score").collect()
    want = []
    for q in range(0, 60, 5):
        mine = sorted((r for r in all_pairs if r.query_id == q), key=lambda r: (-round(r.score, 9), r.vec_id))[:6]
        want += [(q, r.vec_id, r.score, i + 1) for i, r in enumerate(mine)]
    got = vectors.exact_neighbours(rows, asked, limit=6, digits=9, raw=True).select("query_id", "vec_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("marks", [1 << 25, 1 << 16])
def test_texts_that_nobody_trusts_do_not_move(spark, monkeypatch, marks):
    """The rows are those of the join, and few others reach it."""
    from lodestone.llm import quality_lm as Q

    monkeypatch.setattr(Q, "MARKS", marks)
    rows = [(i % 3000 if i % 11 else None, f"text {i}") for i in range(4000)]
    docs, ids = spark.createDataFrame(rows, "id long, text string"), spark.range(0, 5000, 3).repartition(4)
    got = Q._picked(docs, ids)
    assert got.columns == ["id", "text"]
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i, t in rows if i is not None and i % 3 == 0)
    # The same without the last join: what moves.
    met = []
    join = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, *a, **k: (met.append(self), join(self, other, *a, **k))[1])
    Q._picked(docs, ids)
    assert met[-1].count() <= got.count() + 4000 * 2 * 1667 / marks + 20


@pytest.mark.parametrize("closed", [False, True])
def test_references_of_all_kinds_are_resolved_without_python(spark, closed):
    from html.entities import html5

    numbers = [*range(0x120), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]
    given = [f"&{n}" for n in html5] + [f"&{n}x;" for n in html5 if n[-1] != ";"]
    given += [f"&#{z}{n};" for n in numbers for z in ("", "000")] + [f"&#{x}{n:x};" for n in numbers for x in "xX"] + [f"&#x{n:X}" for n in numbers]
    column = B.plain(F.concat(F.lit("<"), "t", F.lit(">")), closed)
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", column.alias("p"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan, plan
    white = lambda t: B_WHITE.sub(" ", t).strip(" ")
    one = lambda t: t if closed and (t[-1] != ";" or t[1] != "#" and t[1:] not in html5) else html.unescape(t)
    got = {given[r.i]: r.p for r in rows.collect()}
    assert {t: p for t, p in got.items() if p != white(f"<{one(t)}>")} == {}


@pytest.mark.parametrize("off", [1e-5, 0.02])
def test_quantiles_are_those_of_all_rows(spark, monkeypatch, off):
    """Ranks of percentile_approx are off by a share of the rows; the thresholds' are not."""
    from lodestone.llm import quality_lm as Q

    monkeypatch.setattr(Q, "OFF", off)
    n = 600_000 if off < 0.01 else 5000
    # Each number once, in another order; ties in the second group, one row in the third.
    values = spark.range(n).selectExpr("'a' AS g", "cast(id * 7919 % {n} AS double) AS v".format(n=n))
    values = values.unionByName(spark.range(1000).selectExpr("'b' AS g", "cast(id % 3 AS double) AS v")).unionByName(spark.range(1).selectExpr("'c' AS g", "4.5D AS v"))
    for q in (0.995, 0.5, 0.0, 1.0):
        got = {r.g: (r.n, r.limit) for r in Q._quantiles(values, "g", "v", q).collect()}
        assert got == {"a": (n, max(-(-int(q * 1000) * n // 1000) - 1, 0)), "b": (1000, {0.995: 2, 0.5: 1, 0.0: 0, 1.0: 2}[q]), "c": (1, 4.5)}, q
