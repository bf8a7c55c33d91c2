from __future__ import annotations

import hashlib
import random

import pytest
import tiktoken
from lodestone.llm import byte_bpe as B
from lodestone.llm import token_counts as C

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SIGNS = " '   \n\t stremdvlLLabZé9½!?- 漢字😀'éΣİß  "
SCHEMA = "doc_id long, text string, ids string, offsets int, decoded int"


def texts() -> list[str | None]:
    r = random.Random(3)
    fixed = [None, "", "'s", "a's 'll", "!'s", " 's", "''s's", " \n x", "  ", "a  ", "x'sre 're've", "'", "'r", "a" * 3000, "ab " * 3000, "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>"]
    return fixed + ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(800)]


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(RANKS), special_tokens={})


def test_round_trip_equals_the_library(spark, library):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts())] + [(0, "again", "x", 1, 2), (None, "again", "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = B.decode(B.encode(df.drop("ids", "offsets", "decoded"), RANKS), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (r.text or "").encode()
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == data
        assert r.offsets == [sum(len(library.decode_single_token_bytes(i)) for i in r.ids[:k]) for k in range(len(r.ids))] or len(r.ids) > 200


def test_digests_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "a b", "x", 1, 2), (2, None, "x", 1, 2)], SCHEMA)
    got = {r.doc_id: r for r in B.round_trip(df, RANKS).collect()}
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary("a b"))).encode()).hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert B.round_trip(df.limit(0), RANKS).count() == 0
    assert B.encode(df, RANKS).schema["ids"].dataType.simpleString() == "array<int>"


def test_own_merging_equals_the_library(library):
    ranks = B.load_ranks(RANKS)
    for t in texts():
        if t:
            assert B.merge_pairs(t.encode(), ranks) == library._core_bpe.encode_single_piece(t.encode())


def test_counts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path)).collect()}
    for i, t in rows:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False)), t
        assert got[i].n_bytes == len((t or "").encode())


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    def cached() -> int:
        return spark.read.parquet(f"{tmp_path}/tokenizer={C.tokenizer_digest(WORDS)}").count()

    first = spark.createDataFrame([(1, "one  two", 0), (2, "one two", 0), (3, None, 0), (3, None, 0)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in C.count_tokens(first, WORDS, str(tmp_path)).collect()) == [0, 0, 2, 2]
    assert cached() == 2
    second = spark.createDataFrame([(1, "one\ttwo", 0), (4, "new", 0)], "doc_id long, text string, n_tokens int")
    assert C.count_tokens(second, WORDS, str(tmp_path)).count() == 2
    assert cached() == 3
    assert C.count_tokens(first.limit(0), WORDS, str(tmp_path)).count() == 0
    assert cached() == 3


def test_checked_ids_with_clashing_columns(spark, library):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts()[:200])] + [(0, "again", "x", 1, 2), (None, "é" * 700_000, None, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA.replace("decoded", "k0"))
    got = {(r.doc_id, r.text): r for r in B.encode_checked(df, RANKS, keep=("doc_id", "text", "k0")).collect()}
    for i, t, *_ in rows:
        assert list(got[i, t].ids) == library.encode_ordinary(t or "")
        assert (got[i, t].n_tokens, got[i, t].decodes, got[i, t].k0) == (len(got[i, t].ids), True, 2)
    assert B.encode_checked(df.limit(0), RANKS, keep=("doc_id",)).columns == ["doc_id", "ids", "n_tokens", "decodes"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_to_their_library_whole(spark, tmp_path, name):
    import sentencepiece
    from tokenizers import Tokenizer

    path = P.path(name)
    if name.endswith(".model"):
        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False))
    rows = [(i, t) for i, t in enumerate([*texts()[:120], "a  b", "a b", "A b"])]
    got = {r.doc_id: r.n_tokens for r in C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, str(tmp_path)).collect()}
    assert got == {i: count(t or "") for i, t in rows}
