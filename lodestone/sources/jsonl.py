"""Item streams of JSON lines, strictly decoded, and the files of retrieval datasets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BYTES, ID_BYTES, MOST_RECORDS = 1 << 20, 4096, 10_000


def decode_item(line: str) -> tuple[str | None, str | None, bool, str | None]:
    """(id, text, deleted, problem): an object with id and either text or deleted: true, nothing else and nothing twice."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name stands twice")
        return dict(pairs)

    try:
        if len(line.encode()) > LINE_BYTES:
            raise ValueError("line too long")
        x = json.loads(line, object_pairs_hook=once)
        if not isinstance(x, dict) or set(x) not in ({"id", "text"}, {"id", "deleted"}):
            raise ValueError("needs id and either text or deleted")
        id_, text = x["id"], x.get("text")
        if not isinstance(id_, str) or not id_ or "\0" in id_ or len(id_.encode()) > ID_BYTES:
            raise ValueError("bad id")
        if "text" in x and not isinstance(text, str):
            raise ValueError("bad text")
        if "deleted" in x and x["deleted"] is not True:
            raise ValueError("deleted must be true")
        (text or "").encode()
        return id_, text, "deleted" in x, None
    except (ValueError, RecursionError) as e:  # unpaired surrogates fail to encode, which is a ValueError
        return None, None, False, str(e)[:200] or "not JSON"


def decode_lines(lines: DataFrame) -> DataFrame:
    """lines: line_no, value -> line_no, item, text, deleted, problem; blank lines go. A repeated item is a problem that names its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, *decode_item(v)) for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v and v.strip(" \t\r\n")]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["line_no", "item", "text", "deleted", "problem"])

    rows = lines.select(F.col("line_no").cast("long"), "value").mapInArrow(run, "line_no long, item string, text string, deleted boolean, problem string")
    first = rows.where("item is not null").groupBy("item").agg(F.min("line_no").alias("_first"))
    again = F.col("line_no") > F.col("_first")
    return rows.join(first, "item", "left").withColumn("problem", F.when(again, F.concat(F.lit("repeats line "), F.col("_first").cast("string"))).otherwise(F.col("problem"))).drop("_first")


def committed(decoded: DataFrame) -> DataFrame:
    """Records before the first bad line."""
    bad = decoded.agg(F.min(F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("_bad"))
    return decoded.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("line_no") < F.col("_bad"))).drop("_bad", "problem")  # bad: one row


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a text file, in file order (one reader task, as such streams are small)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).select((F.col("line_no") + 1).cast("long").alias("line_no"), "value")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: title and text, trimmed."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws("\n", F.nullif("title", F.lit("")), "text")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, position in the file."""
    lines = read_lines(spark, path)
    got = F.from_json("value", "_id string, text string")
    return lines.where(F.trim("value") != "").select(got["_id"].alias("query_id"), got["text"].alias("text"), F.col("line_no").alias("position"))


def parse_judgments(lines: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """lines: line_no, value -> query_id, doc_id, gain: three or four tab-separated columns, a header may stand first, unknown ids go, the last line wins."""
    parts = F.split(F.trim("value"), "\t")
    four = F.size(parts) == 4
    rows = lines.where(F.trim("value") != "").select("line_no", parts[0].alias("query_id"), F.when(four, F.try_element_at(parts, F.lit(3))).otherwise(F.try_element_at(parts, F.lit(2))).alias("doc_id"), F.element_at(parts, -1).try_cast("int").alias("gain"))
    rows = rows.where(~((F.col("line_no") == 1) & F.col("gain").isNull()))
    rows = rows.join(queries.select("query_id"), "query_id", "left_semi").join(corpus.select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("gain", "line_no").alias("gain"))


def limit_corpus(corpus: DataFrame, judgments: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first n documents by id, the judgments on them, and the queries that keep one."""
    docs = corpus.orderBy("doc_id").limit(n)
    kept = judgments.join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs, kept, queries.join(kept.where("gain > 0").select("query_id").distinct(), "query_id", "left_semi")


def decode_vectors(imports: DataFrame, value: str = "value") -> DataFrame:
    """Vector imports as rows; a malformed one or a non-finite number is an error."""
    schema = "space struct<provider:string,model:string,version:string,dimensions:int,metric:string>, embeddings array<struct<source_id:string,segment_id:string,representation_id:string,content_sha256:string,values:array<double>>>"
    got = F.from_json(value, schema, {"mode": "FAILFAST"})
    rows = imports.select(got.alias("x")).select("x.space", F.explode("x.embeddings").alias("e")).select("space", "e.*")
    good = (F.size("values") == F.col("space.dimensions")) & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("values", lambda v: v != 0)
    return rows.withColumn("values", F.when(good, F.col("values")).otherwise(F.raise_error(F.lit("bad vector"))))


def zipf_corpus(spark: SparkSession, n: int, words: int = 200, vocabulary: int = 20_000, seed: int = 1) -> DataFrame:
    """Synthetic documents whose word frequencies fall as 1 / rank, for benches."""
    word = lambda i: F.floor(F.pow(F.lit(float(vocabulary)), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))).cast("string")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), word(i))), " ").alias("text"))
