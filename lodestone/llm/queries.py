"""The thin ``opN_`` queries over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, prepare, read_table

TOKEN_LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats, whole_characters

    done = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    # After the contract's columns comes ``text``, what is left, so that removals can be read and not only counted.
    return whole_characters(done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept"))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import judge

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge(documents, read_table(spark, sf_dir, "labels"))
    return judged.withColumn("kept", ~F.col("rejected"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import link_vectors

    return link_vectors(read_table(spark, sf_dir, "embeddings"), least=0.98)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    # A cache of its own, so that each run encodes all distinct texts of its table.
    counted = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), fresh_dir(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_pages, write_pages

    archives = fresh_dir(spark, "warc")
    write_pages(read_table(spark, sf_dir, "pages"), archives, least_bytes=0)
    return read_pages(spark, archives)


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_forest import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), every=50, top=5)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# The CRC goes byte by byte through a table made in SQL, once for each distinct feature.
OP11_SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
cut AS (SELECT side, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
spread AS (SELECT side, r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM cut),
runs AS (SELECT side, r, w, lead(w, 1) OVER a AS w2, lead(w, 2) OVER a AS w3 FROM spread WINDOW a AS (PARTITION BY side, r ORDER BY i)),
grams AS (SELECT side, r, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS f FROM runs),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST(('0x' || substr(hex(encode(f)), 2 * i - 1, 2)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM grams WHERE f IS NOT NULL), crc_table),
found AS (SELECT side, r, bucket, count(*) AS n FROM grams JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM found GROUP BY bucket),
every AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS gain FROM sums, every),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS may,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts JOIN cut USING (side, r) LEFT JOIN weights USING (r) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY may) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * n // 100 THEN place END AS rank FROM placed"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import divergence

    return divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
hits AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM hits GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, v, langs.total AS lang_total, coalesce(CAST(s.n AS HUGEINT), 0) AS total FROM groups JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) s USING (lang, source)),
shares AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + v) AS p, 1 + 1000000000 * (kept.n + 1) // (lang_total + v) AS q
  FROM totals t JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, CAST(value AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


OP7_SQL = """
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT * FROM given WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT r, r AS c FROM given
  UNION
  SELECT reach.r, links.b FROM reach JOIN links ON reach.c = links.a),
named AS (SELECT reach.r, min(g.vec_id) AS component_id FROM reach JOIN given g ON g.r = reach.c GROUP BY ALL)
SELECT given.vec_id, (SELECT count(*) FROM links WHERE links.a = given.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM given JOIN named USING (r)"""


def _level(name: str, source: str, parent: list[str], weight: str) -> str:
    """SQL for one level of the budget tree: ``shares_{name}`` from the level above."""
    path = ", ".join([*parent, name])
    family = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"({family} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    join = f"JOIN {source} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {source}"
    return f"""
nodes_{name} AS (SELECT {path}, CAST(sum(tokens) * 3 AS BIGINT) AS cap, {weight} AS w FROM leaves GROUP BY {path}),
full_{name} AS (SELECT *, cap * (sum(w) OVER ({family}) - coalesce(sum(w) OVER {order}, 0)) <= w * (budget - coalesce(sum(cap) OVER {order}, 0)) AS is_full FROM nodes_{name} {join}),
shares_{name} AS (SELECT {path}, CAST(CASE WHEN is_full THEN cap ELSE coalesce((w * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({family}), 0))) // nullif(sum(w) FILTER (NOT is_full) OVER ({family}), 0), 0) END AS BIGINT) AS budget FROM full_{name}),"""


def _op10_sql() -> str:
    lang = "CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 20 WHEN 'de' THEN 20 ELSE 10 END"
    domain = "CASE domain WHEN 'domain0' THEN 40 WHEN 'domain1' THEN 30 WHEN 'domain2' THEN 20 ELSE 10 END"
    return f"""
WITH docs AS (
  SELECT doc_id, lang AS lang_in, source AS source_in, text, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    coalesce('domain' || CAST(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR), 'none') AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '')) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
total AS (SELECT CAST(coalesce(sum(tokens), 0) * 60 // 100 AS BIGINT) AS budget FROM leaves),
{_level("domain", "total", [], domain)}
{_level("lang", "shares_domain", ["domain"], lang)}
{_level("source", "shares_lang", ["domain", "lang"], "10")}
plans AS (SELECT domain, lang, source, budget // tokens AS n_full, budget % tokens AS n_left FROM leaves JOIN shares_source USING (domain, lang, source) WHERE tokens > 0),
placed AS (
  SELECT docs.*, n_full, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('mix-1:' || CAST(n_full AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens, text ROWS UNBOUNDED PRECEDING) <= n_left AND n_left > 0 AS taken
  FROM docs JOIN plans USING (domain, lang, source))
SELECT doc_id, lang_in AS lang, source_in AS source, domain, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(unnest(range(0, CAST(n_full + CASE WHEN taken THEN 1 ELSE 0 END AS BIGINT))) AS INT) AS epoch
FROM placed"""


def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    runs = [op1_warc, op2_hash_prefix_forest, op3_minhash_dedup, op4_html_text, op5_suffix_dedup, op6_quality_lm, op7_embedding_dedup, op8_byte_bpe, op9_token_counts, op10_source_mix, op11_importance, op12_language_id, op13_source_audit]
    return {f.__name__: _shipped(f) for f in runs}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_source_mix": _op10_sql(),
        "op11_importance": OP11_SQL,
        "op13_source_audit": OP13_SQL,
        "op7_embedding_dedup": OP7_SQL,
    }
