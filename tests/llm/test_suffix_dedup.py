from __future__ import annotations

import random
from collections import Counter

import pytest
from lodestone.llm import suffix_dedup as S


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, bytes]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def documents(length: int) -> list[str | None]:
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdeé \x00") for _ in range(n))
    shared = [word(length + r.randint(0, 3 * length)) for _ in range(4)]
    out: list[str | None] = [None, "", "a", shared[0], shared[0], "z" * (5 * length), word(length - 1)]
    for _ in range(60):
        out.append("".join(r.choice([word(r.randint(1, 2 * length)), r.choice(shared), r.choice(shared)[r.randint(0, length) :]]) for _ in range(r.randint(1, 5))))
    hot = word(length + 20)
    return out + [word(r.randint(0, 50)) + hot + word(r.randint(0, 50)) for _ in range(40)] + [word(40 * length), shared[1] * 6]


@pytest.mark.parametrize(("length", "group"), [(40, 2048), (40, 6), (7, 2048)])
def test_against_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(S, "GROUP", group)
    texts = documents(length)
    df = spark.createDataFrame([(None if i == 9 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, length).collect()}
    for i, expected in enumerate(brute(texts, length)):
        assert got[None if i == 9 else i] == expected, i


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "SCAN", 100)
    texts = documents(40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = [p for t in texts for p in S._pieces((t or "").encode(), 40)]
    assert sum(int(n.sum()) for _, n, _, _ in pieces) == sum(max(0, len((t or "").encode()) - 39) for t in texts)
    assert df.count() == len(texts)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" + "ab" * 30, 5), (1, "q" + "ab" * 30, 5), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.remove_repeats(df, 40).collect())
    assert got == [(0, 0, 0), (1, 61, 61), (1, 61, 61)]
    assert S.remove_repeats(df.limit(0), 40).count() == 0


@pytest.mark.parametrize(("length", "words"), [(400, 50), (400, 65), (400, 80), (250, 55)])
def test_planted_passages_over_many_documents(spark, monkeypatch, length, words):
    """Passages of 50 to 80 words in many documents, crowded anchors: as brute force has it at either length."""
    monkeypatch.setattr(S, "GROUP", 8)
    r = random.Random(words)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    planted = [prose(words) for _ in range(4)]
    texts = [f"{prose(r.randint(5, 60))} {planted[i % 4] if i % 5 else ''} {prose(r.randint(5, 60))}" for i in range(110)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(31)
    got = {x.doc_id: (x.n_removed, x.n_spans, bytes(x.kept)) for x in S.remove_repeats(df, length).collect()}
    for i, expected in enumerate(brute(texts, length)):
        assert got[i] == expected, i
    caught = [i % 5 != 0 and got[i][0] > 0 for i in range(len(texts))]
    long = [len(p) >= length for p in planted]
    assert all(c for i, c in enumerate(caught) if i % 5 and long[i % 4])


def test_query_gives_what_is_left_after_the_contracts_columns(spark, tmp_path):
    """Planted passages of over 50 words: those of 400 bytes go from every text, shorter ones stay, n_bytes is the input's length."""
    import hashlib

    from lodestone.llm import queries as Q

    r = random.Random(9)
    prose = lambda n, k: " ".join("".join(r.choice("abcdefghijklmnopqé") for _ in range(k)) for _ in range(n))
    planted = [prose(55, 8), prose(55, 5), prose(70, 7)]
    sizes = [len(p.encode()) for p in planted]
    assert sizes[1] < 400 <= min(sizes[0], sizes[2])
    # The last two differ in the second byte of a character, so that a removed run ends within it.
    texts = [None, "", *(f"{prose(20, 6)} {planted[i % 3]} {prose(20, 6)}" for i in range(12)), *(prose(90, 6) for _ in range(4)), "q" * 30 + planted[0] + "\u00e9", "w" * 30 + planted[0] + "\u00e8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = Q.queries()["op5_suffix_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {x.doc_id: x for x in found.collect()}
    for i, (removed, spans, kept) in enumerate(brute(texts, 400)):
        assert got[i][1:] == (len((texts[i] or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), i
    holds = [sum(p in x.text for x in got.values()) for p in planted]
    assert holds == [0, 4, 0]
    assert [got[i].n_removed for i in range(14, 18)] == [0] * 4
