"""From raw documents to token ids: five stages, each over all that the one before kept.

Rows without a counterpart in SQL (language model, sketches, repeated strings, tokenizer)
make ORACLE_SQL impossible; tests hold the stages against plain versions on a small table.

All stages but the last give the columns that they get, whatever their names; further columns of documents pass. A null text counts as an
empty one, which the first three stages keep and mixing takes as a text of no words. Repeated rows are one group of near copies. Ties go by the smallest doc_id. Texts of any
length are taken whole. Empty tables give empty results.
"""

from __future__ import annotations

from lodestone.llm import byte_bpe, minhash_dedup, mixing, quality_lm, suffix_dedup
from lodestone.llm.common import fresh_dir, prepare, read_table, rest
from lodestone.llm.queries import tokenizer_path
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a string that counts as a repeated passage: about 50 short words.
PASSAGE = 250
MIX = mixing.Mix(percent=90, max_epochs=2)


def _begin(spark: SparkSession) -> None:
    """What the stage before left in executors' memory is freed before the next one needs it."""
    prepare(spark)
    rest(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't far above that of trusted text in their language."""
    _begin(spark)
    return quality_lm.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more)."""
    _begin(spark)
    return minhash_dedup.one_of_each(docs, width=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; a document of which nothing is left goes."""
    _begin(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domain, language and source; a second epoch repeats rows."""
    _begin(spark)
    return mixing.mixed_rows(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    _begin(spark)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_checked(docs, path, keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
