from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from lodestone.llm import quality_lm as Q
from pyspark.sql import functions as F


def classes(text: str) -> list[int]:
    code, _ = Q.grams([text], 1)
    return code.tolist()


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcd", "abcde"])
def test_grams_of_very_short_texts(text):
    s = [Q.START] * 4 + classes(text)
    code, lengths = Q.grams([text], 5)
    assert code.tolist() == [sum(c * Q.ALPHABET**k for k, c in enumerate(reversed(s[i : i + 5]))) for i in range(len(text))]
    assert lengths.tolist() == [len(text)]


def test_letters_of_other_scripts_are_told_apart():
    assert Q.ALPHABET**Q.ORDER < 2**63
    for a, b in ("жш", "λμ", "بت", "अआ", "กข", "あい", "中文", "ж→", "あ→", "ж•"):
        assert classes(a) != classes(b), (a, b)
    assert classes("Ж٣\u3000") == classes("Z3 ")
    r = random.Random(1)
    clean = [" ".join(r.choice(["мир", "вода", "слово", "дерево"]) for _ in range(20)) for _ in range(20)]
    p = brute_model(clean, 3)
    mean = lambda t: sum(math.log(p(tuple(s[i - 2 : i]), s[i])) for s in [[Q.START] * 2 + classes(t)] for i in range(2, len(s))) / len(t)
    junk = "".join(r.sample(clean[0], len(clean[0])))
    assert mean(clean[0]) > mean(junk) + 1


def brute_model(texts: list[str], order: int):
    """Interpolated modified Kneser-Ney from its definition; gives p(next | history)."""
    pad = [Q.START] * (order - 1)
    full = Counter(tuple(s[i - order + 1 : i + 1]) for t in texts for s in [pad + classes(t)] for i in range(order - 1, len(s)))
    counts = {order: full}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {}
    for k, c in counts.items():
        n = Counter(c.values())
        n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        disc[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
    by = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            by[k][g[:-1]][g[-1]] = n

    def p(history: tuple, nxt: int) -> float:
        k = len(history) + 1
        lower = 1 / Q.ALPHABET if k == 1 else p(history[1:], nxt)
        seen = by[k].get(history)
        if not seen:
            return lower
        total = sum(seen.values())
        d = lambda n: disc[k][min(n, 3) - 1]
        n = seen.get(nxt, 0)
        return (n - d(n) if n else 0) / total + sum(map(d, seen.values())) / total * lower

    return p


@pytest.fixture(scope="module")
def texts() -> list[str]:
    r = random.Random(2)
    words = ["the", "of", "Étude", "is", "tion", "and", "water", "ring", "ça", "12"]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) + "." for _ in range(150)]


def test_probabilities_against_the_definition(spark, texts, monkeypatch):
    order = 3
    monkeypatch.setattr(Q, "AT_ONCE", 37)
    tables = Q.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    docs = [*texts[:20], "zq %% XX", "", None, "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.nll, r.n_scored) for r in Q.score(df, tables, ["doc_id"], 3, order=order).collect()}
    p = brute_model(texts, order)
    for i, t in enumerate(docs):
        s = [Q.START] * (order - 1) + classes(t or "")
        nll = -sum(math.log(p(tuple(s[k - order + 1 : k]), s[k])) for k in range(order - 1, len(s)))
        assert got[i][1] == len(t or "")
        assert got[i][0] == pytest.approx(nll, abs=1e-6)


def test_judgments(spark, texts, monkeypatch):
    monkeypatch.setattr(Q, "LEAST", 5)
    r = random.Random(3)
    junk = ["".join(r.choice("%$#&QXZ!") for _ in range(120)) for _ in range(5)]
    rows = [(i, t, "en" if i % 2 else "fr", "x") for i, t in enumerate(texts)] + [(1000 + i, t, "en", "x") for i, t in enumerate(junk)] + [(2000, None, "en", "x"), (2001, "", None, "x"), (None, texts[0], None, "x"), (5, texts[5], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs, labels, keep=docs.columns[:3]).collect()
    assert len(got) == len(rows)
    assert {x.doc_id for x in got if x.rejected} == set(range(1000, 1005))
    none = Q.judge(docs, labels.limit(0))
    assert none.where("rejected").count() == 0 and none.count() == len(rows)
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert none.where(F.col("doc_id") == 2000).first().perplexity is None


LABELLED = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not LABELLED.exists(), reason="needs the labelled tables")
def test_rates_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    judged = Q.judge(docs.select("doc_id", "text", "lang"), labels).join(labels.select("doc_id", "quality"), "doc_id")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share[0] >= 0.95
    assert share[1] <= 0.005


def test_each_language_has_its_own_sample(spark, monkeypatch):
    monkeypatch.setattr(Q, "LEAST", 10)
    r = random.Random(5)
    words = {"en": ["the", "of", "water", "ring"], "xx": ["qzvwk", "jxkpf", "vqqzj", "wxyzk", "kkjjq", "zvxwf", "pqkzx"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(5, 30))), lang) for i in range(600) for lang in ["xx" if i % 10 == 0 else "en"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(600)], "doc_id long, quality int")
    got = Q.judge(docs, labels, sample=40).collect()
    assert len({x.threshold for x in got}) == 2
    assert sum(x.rejected for x in got if x.lang == "xx") <= 3


def test_the_model_is_fitted_on_all_trusted_text_that_is_not_held_out(spark, monkeypatch):
    rows = [(i, ("ab" if i % 2 else "xyz ") * (i % 7 + 1), "en") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id int, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(60)], "doc_id int, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda trusted, order, fit=Q.fit: (seen.append(sorted(r.text for r in trusted.collect())), fit(trusted, order))[1])
    assert not hasattr(Q, "TRUSTED")
    Q.judge(docs, labels).collect()
    kept = docs.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) != 0)
    assert seen == [sorted(r.text for r in kept.collect())]
