"""Token counts with a cache keyed by digests of content and tokenizer.

Texts are joined by the digest of their normalised content to the counts stored
for this tokenizer; what is missing is made distinct, encoded once, and appended.
Normalising collapses runs of ASCII white space into a space, which this kind of
tokenizer drops, so texts with equal digests have equal counts.

Within a batch, where the tokenizer's file states the known normaliser and split, texts are cut where it cuts them (letters, digits,
other signs, contractions), equal slices are found by hash, and the tokenizer's
library encodes each distinct slice once a worker. Texts that hold one of its
special strings, and all texts for any other tokenizer, go to the library whole. White space is only
collapsed for the known kind; for others the digest is that of the text as it is.

Edge cases: a null text counts as the empty text (0 bytes, 0 tokens). Repeated
rows each get a row. Extra columns of the input, whatever their names, are not read. Texts are encoded
whole. An empty table gives an empty table and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import _chunks, slice_starts
from .common import stored, thrifty
from .rolling import BASES, slice_hashes

CACHE_SCHEMA = "content_digest string, n_tokens long"
_counters: dict[str, _Counter | _Pieces] = {}


# What a tokenizer's file states if texts may be cut here.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache
def cuts_like_words(path: str) -> bool:
    """Whether the file is of the kind whose cuts are known: lower case, words, white space dropped."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    normalizer, split = stated.get("normalizer") or {}, (stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = split[0]
    return (
        normalizer.get("normalizers") == KNOWN_NORMALIZER
        and len(split) == 2
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": KNOWN_SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and split[1].get("type") == "ByteLevel"
        and not split[1].get("add_prefix_space")
        and not split[1].get("use_regex")
        and not any(t.get("normalized") or t.get("single_word") for t in stated.get("added_tokens", []))
    )


class _Pieces:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class _Counter:
    def __init__(self, path: str, room: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = cuts_like_words(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.room = room

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def slices(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = pieces
        self.known.update(zip(new, self.whole(new), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.whole(texts)
        out = np.zeros(len(texts), np.int64)
        odd = [i for i, x in enumerate(texts) if any(s in x for s in self.special)]
        if odd:
            out[odd] = self.whole([texts[i] for i in odd])
        held = set(odd)
        plain = ["" if i in held else unicodedata.normalize("NFC", x).replace("Σ", "σ").lower() for i, x in enumerate(texts)]
        joined = "".join(plain)
        if joined:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, plain), np.int64, len(plain))
            stops = np.cumsum(lengths)
            starts = slice_starts(points, (stops - lengths)[lengths > 0], join_space=False)
            ends = np.append(starts[1:], len(points))
            key, check = (slice_hashes(points, starts, ends, b) for b in BASES)
            _, at, which = np.unique(key, return_index=True, return_inverse=True)
            if not np.array_equal(check[at][which], check):  # a collision: no sharing
                at = which = np.arange(len(starts))
            pieces = list(map(joined.__getitem__, map(slice, starts[at].tolist(), ends[at].tolist())))
            total = np.concatenate([[0], np.cumsum(self.slices(pieces)[which])])
            out += np.diff(total[np.searchsorted(starts, stops)], prepend=0)
        return out.tolist()


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library for ``path`` gives them without special tokens added."""
    if path not in _counters:
        _counters.clear()  # one at a time stays with a worker
        _counters[path] = _Pieces(path) if path.endswith(".model") else _Counter(path)
    return [n for chunk in _chunks(texts) for n in _counters[path].count(chunk)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest(text: str, collapse: bool = True) -> F.Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.sha2((F.regexp_replace(whole, r"[ \t-\r]+", " ") if collapse else whole).cast("binary"), 256)


def _cached(spark: SparkSession, place: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(place)


def count_tokens(df: DataFrame, tokenizer_path: str, cache_dir: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_bytes and n_tokens; counts that the cache lacked are appended to it first."""
    spark = df.sparkSession
    place = f"{cache_dir}/tokenizer={tokenizer_digest(tokenizer_path)}"
    collapse = cuts_like_words(tokenizer_path)
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("content_digest", content_digest("_text", collapse))
    cached = _cached(spark, place)
    missing = rows if cached is None else rows.join(cached, "content_digest", "left_anti")
    distinct = missing.groupBy("content_digest").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_texts(b.column(1).to_pylist(), tokenizer_path), pa.int64())], names=["content_digest", "n_tokens"])

    distinct.mapInArrow(thrifty(run), CACHE_SCHEMA).write.mode("append").parquet(place)
    # Two runs at once may both append a digest; any of its equal counts will do. Stored, so that a text of very many rows can be split.
    counts = stored(spark.read.schema(CACHE_SCHEMA).parquet(place).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "distinct-counts")
    inner = df.select(F.struct(*keep).alias("kept"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), content_digest(text, collapse).alias("content_digest"))
    return inner.join(counts, "content_digest").select("kept.*", "n_bytes", "n_tokens")
