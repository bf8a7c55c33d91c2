"""Divergence of sources against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from lodestone.llm import duck, source_audit

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows: list[tuple], top: int) -> list[tuple]:
    counts, found = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        found[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in found.items()}
    share = lambda c, lang, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept[lang]) + len(kept[lang]))
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for (lang, source), c in counts.items():
        whole = sum((x for (at, _), x in counts.items() if at == lang), Counter())
        pairs = [(sum(f(share(c, lang, t), share(x, lang, t)) for t in kept[lang]), o) for (at, o), x in counts.items() if at == lang and o != source]
        terms = [(f(share(c, lang, t), share(whole, lang, t)), t) for t in kept[lang] if c[t] and share(c, lang, t) > share(whole, lang, t)]
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


@pytest.mark.parametrize(("piece", "held", "top"), [(duck.PIECE, source_audit.HELD, 200), (40, 30, 3)])
def test_divergence_against_plain(spark, monkeypatch, piece, held, top):
    rng = random.Random(11)
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "PART", held)
    vocabulary = ["the", "Of", "Étude", "a_b", "x9y", "日本", "zebra", "APPLE", "pear", *(f"w{'abcdefgh'[i % 8]}{'qrstuvwx'[i // 8]}" for i in range(64))]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([9, 30, 73])]) for _ in range(n))
    rows = [(text(rng.choice([0, 1, 5, 30])), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "É"])) for _ in range(160)]
    rows += [rows[0]] * 5 + [(None, "en", "only null"), ("", "xx", "a"), ("one two", "xx", "b"), (text(900), "en", "long"), ("", None, None)]
    documents = spark.createDataFrame([(*r, 7, 8) for r in rows], "text string, lang string, source string, n int, term int").repartition(3)
    found = source_audit.divergence(documents, top=top, piece=piece)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, top)


def test_no_documents(spark):
    assert source_audit.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(4 * 10**18, 9 * 10**18, 3)], "n long, total long, v long").select(source_audit._share(*[source_audit.F.col(c) for c in ("n", "total", "v")]).alias("p")).first()
    assert row.p == 1 + 10**9 * (4 * 10**18 + 1) // (9 * 10**18 + 3)


def test_terms_of_bytes_against_the_pattern():
    texts = ["", "Ab[c`d{e\x7ff", "", "x", "yZ", "\x00É日本 a_b1c@D", " ", "\u0080\u07ff\uffff\U0001f600Q", "end"]
    for first in range(len(texts) + 1):
        of, words = source_audit._terms(pa.array(texts).slice(first))
        expected = [(i, t) for i, x in enumerate(texts[first:]) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", x.translate(LOWER))]
        assert list(zip(of.tolist(), words.to_pylist(), strict=True)) == expected


def test_a_task_sums_before_it_hands_on(monkeypatch):
    """Twenty batches of the same five terms in three sources: one row a term, not rows of every batch."""
    monkeypatch.setattr(source_audit, "HELD", 40)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "b", "c"], "text": ["v w x y z v"] * 3})
    found = pa.Table.from_batches(source_audit._term_counter(duck.PIECE)(iter([batch] * 20))).to_pylist()
    assert len(found) == 5
    for row in found:
        assert (row["lang"], row["sources"], row["n"], row["n_docs"]) == ("en", ["a", "b", "c"], [40 if row["term"] == "v" else 20] * 3, [20] * 3)


@pytest.mark.parametrize(("held_bytes", "sources"), [(1, 2), (1 << 28, 1)])
def test_divergence_of_many_sources_and_small_parts(spark, monkeypatch, held_bytes, sources):
    """Sources of a term in several rows, counts handed on after every batch, a term in two languages."""
    monkeypatch.setattr(source_audit, "HELD_BYTES", held_bytes)
    monkeypatch.setattr(source_audit, "SOURCES", sources)
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["a", "B", "É", "ab", "ba", f"w{'xyz'[i % 3]}"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "de"]), f"s{i % 7}") for i in range(90)]
    documents = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert sorted(map(tuple, source_audit.divergence(documents).collect())) == plain(rows, 200)
