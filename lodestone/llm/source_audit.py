"""How far the sources of a language differ: smoothed term shares of each source against those of its language and of the other sources.

Partitions number their terms and count the numbers in DuckDB. The counts, a row for a term with its sources, are dealt into shards by
language and term, so a shard has all there is about a term: DuckDB sums it there, drops rare terms, and later adds up what pairs of
sources share. Spark merges sums and rankings.

Sums over all terms need no table of all terms by all sources: a pair of sources has V terms at the value of two zero counts, plus what
changes for terms of one source (by how often each count occurs), plus what changes for terms of both (by the shards).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import duck
from .common import join_table, prepare, stored, thrifty

SCALE = 1_000_000_000
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Each byte of UTF-8 as it stands in terms, 0 for those between: A to Z become lower case, whatever isn't ASCII belongs to terms.
_BYTES = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 0 for i in range(256)], np.uint8)
#: Counted rows, and their bytes, that a task holds before it sums them, and hands them on if half as many are left.
HELD, HELD_BYTES = 1_500_000, 256 << 20
#: Rows of a shard that one statement takes.
PART = 60_000
#: Sources of a term in one row of counts at most.
SOURCES = 32
#: Parts of a group whose best terms are found apart.
SALTS = 64

_COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
_COUNTED_DDL = "lang string, term string, sources array<string>, n array<long>, n_docs array<long>"
_SUMMED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM {} GROUP BY ALL"


# A long text lies in several statements.
_BY_GROUP = "SELECT place, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM (SELECT row, term, sum(n) AS n FROM given GROUP BY ALL) JOIN rows_of USING (row) GROUP BY ALL"
_BY_PLACE = "SELECT place, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM given GROUP BY ALL"


def _handed(table: pa.Table, schema: pa.Schema, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=most)


def _terms(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """The terms of texts without nulls, lower-cased, and for each the place of its text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    data = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]  # a term doesn't go on into the next text
    begins = np.flatnonzero(begins)
    kept = data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[begins] - 1, len(kept)).astype(np.int32)
    return np.searchsorted(ends[1:], begins, side="right"), pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(kept))


def _numbered(tables: list[pa.Table]) -> tuple[pa.Table, pa.Array]:
    """Tables on end with numbers for their terms, and the term of each number."""
    whole = pa.concat_tables(tables).unify_dictionaries().combine_chunks()
    terms = whole["term"].chunk(0) if whole.num_rows else pa.array([], pa.dictionary(pa.int32(), pa.string()))
    return whole.set_column(whole.schema.get_field_index("term"), "term", terms.indices), terms.dictionary


def _named(table: pa.Table, terms: pa.Array) -> pa.Table:
    named = pa.DictionaryArray.from_arrays(table["term"].combine_chunks().cast(pa.int32()), terms)
    return table.set_column(table.schema.get_field_index("term"), "term", named)


def _packed(held: pa.Table, groups: list[tuple[str, str]]) -> pa.Table:
    """Counts by numbers of groups -> rows of a language's term with up to SOURCES sources."""
    ordered = sorted(range(len(groups)), key=groups.__getitem__)
    parts: dict[tuple[str, int], int] = {}
    seen: dict[str, int] = {}
    part, place = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
    for i, g in enumerate(ordered):
        lang = groups[g][0]
        seen[lang] = seen.get(lang, -1) + 1
        place[g], part[i] = i, parts.setdefault((lang, seen[lang] // SOURCES), len(parts))
    held, terms = _numbered([held])
    which, term = place[held["place"].to_numpy()], held["term"].to_numpy().astype(np.int64)
    order = np.argsort(term * len(groups) + which)
    which, term = which[order], term[order]
    cut = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(part[which], prepend=-1) != 0))
    offsets = pa.array(np.append(cut, len(order)), pa.int32())
    langs, sources = (pa.array([groups[g][k] for g in ordered], pa.string()) for k in (0, 1))
    lists = [sources.take(pa.array(which)), *(pa.array(held[c].to_numpy()[order]) for c in ("n", "n_docs"))]
    return pa.table([langs.take(pa.array(which[cut])), terms.take(pa.array(term[cut])), *(pa.ListArray.from_arrays(offsets, x) for x in lists)], schema=_COUNTED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each source again."""
    for b in batches:
        of = pc.list_parent_indices(b.column("sources"))
        columns = {"lang": b.column("lang").take(of), "source": pc.list_flatten(b.column("sources")), "term": b.column("term").take(of)}
        yield pa.RecordBatch.from_pydict(columns | {c: pc.list_flatten(b.column(c)) for c in ("n", "n_docs")})


def _term_counter(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lang, source, text to lang, term, sources, n, n_docs: sums over the rows that a task holds at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(duck.connect("500MB")) as db:

            def counted(tables: list[pa.Table], query: str) -> pa.Table:
                table, terms = _numbered(tables)
                db.register("given", table)
                found = db.sql(query).to_arrow_table()
                db.unregister("given")
                return _named(found, terms)

            held: list[pa.Table] = []
            groups: dict[tuple[str, str], int] = {}
            size = held_bytes = 0
            for batch in batches:
                places = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                db.register("rows_of", pa.table({"row": pa.array(range(batch.num_rows), pa.int32()), "place": pa.array(places, pa.int32())}))
                by_row = []
                for texts in duck.statements(batch.column(2), GAP, most=piece):
                    of, words = _terms(texts["text"].chunk(0))
                    words = pa.table({"row": texts["row"].to_numpy()[of], "term": words.dictionary_encode()})
                    by_row.append(counted([words], "SELECT row, term, count(*) AS n FROM given GROUP BY ALL"))
                if by_row:
                    held.append(counted(by_row, _BY_GROUP))
                    size, held_bytes = size + held[-1].num_rows, held_bytes + held[-1].nbytes
                db.unregister("rows_of")
                if size > HELD or held_bytes > HELD_BYTES:
                    held = [counted(held, _BY_PLACE)]
                    size, held_bytes = held[0].num_rows, held[0].nbytes
                    if size > HELD // 2 or held_bytes > HELD_BYTES // 2:
                        yield from _handed(_packed(held[0], list(groups)), _COUNTED, 10_000)
                        held, groups, size, held_bytes = [], {}, 0, 0
            if held:
                yield from _handed(_packed(counted(held, _BY_PLACE), list(groups)), _COUNTED, 10_000)

    return thrifty(count)


def _whole_terms(batches: Iterator[pa.RecordBatch], db, summed: str | None = None) -> Iterator[pa.Table]:
    """Rows of whole terms of a sorted shard, part by part. ``summed`` makes fewer rows of those of a term that goes on."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        if sum(x.num_rows for x in rest) < PART:
            continue
        table = pa.Table.from_batches(rest)
        ends = [table.column(c)[table.num_rows - 1] for c in ("lang", "term")]
        same = pc.sum(pc.and_(*[pc.equal(table.column(c), v) for c, v in zip(("lang", "term"), ends, strict=True)])).as_py()
        held = table.slice(table.num_rows - same)
        if summed and same > PART // 2:
            db.register("held_rows", held)
            held = db.sql(summed.format("held_rows")).to_arrow_table().select(table.schema.names).cast(table.schema)
            db.unregister("held_rows")
        rest = held.to_batches()
        yield table.slice(0, table.num_rows - same)
    if rest:
        yield pa.Table.from_batches(rest)


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("leads", pa.bool_())])
_KEPT_DDL = "lang string, term string, source string, n long, lang_n long, leads boolean"


def _keeper(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A sorted shard's counts summed, without terms of fewer than ``least`` documents of the language."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(duck.connect("300MB")) as db:
            for part in _whole_terms(_unpacked(batches), db, _SUMMED):
                db.register("part", part)
                found = db.sql(
                    f"""SELECT lang, term, source, n, CAST(sum(n) OVER of_term AS BIGINT) AS lang_n, source = min(source) OVER of_term AS leads
                    FROM ({_SUMMED.format("part")}) WINDOW of_term AS (PARTITION BY lang, term) QUALIFY sum(n_docs) OVER of_term >= {int(least)}"""
                ).to_arrow_table()
                yield from _handed(found, _KEPT)

    return thrifty(keep)


def _value(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


_PARTIAL = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])
_PARTIAL_DDL = "part string, lang string, source string, item string, value decimal(38,0)"
#: What changes for a term of both sources, against the sum of what changes for it as one of the first and of the second.
_SHARED = f"""INSERT INTO pairs SELECT a.lang, a.source, b.source,
  sum({_value("a.p", "b.p")} - {_value("a.p", "b.p0")} - {_value("a.p0", "b.p")} + {_value("a.p0", "b.p0")})
FROM these a JOIN part b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
_BEST = "SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {}"


def _adder(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A sorted shard's sums by pair of sources, and its best terms of each group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(duck.connect("500MB")) as db:
            for name in ("pairs", "best"):
                db.execute(f"CREATE TABLE {name} (lang VARCHAR, source VARCHAR, item VARCHAR, value HUGEINT)")
            summed, best = "SELECT lang, source, item, sum(value) AS value FROM pairs GROUP BY ALL", _BEST.format("best", int(top))
            sizes = {"pairs": 0, "best": 0}

            def taken(part: str, query: str) -> Iterator[pa.RecordBatch]:
                yield from _handed(db.sql(f"SELECT '{part}' AS part, lang, source, item, CAST(value AS DECIMAL(38, 0)) AS value FROM ({query})").to_arrow_table(), _PARTIAL)

            def bounded(name: str, part: str, query: str) -> Iterator[pa.RecordBatch]:
                """Makes fewer rows of a table that has become large, and hands them on if they are still many."""
                if sizes[name] > HELD:
                    sizes[name] = duck.first(db, f"CREATE OR REPLACE TABLE {name} AS {query}")[0]
                    if sizes[name] > HELD // 2:
                        yield from taken(part, f"FROM {name}")
                        db.execute(f"DELETE FROM {name}")
                        sizes[name] = 0

            for part in _whole_terms(batches, db):
                db.register("part", part)
                most = duck.first(db, "SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY lang, term)")[0] or 1
                # A row meets the other sources of its term: rows go in such numbers that one statement stays small.
                many = max(1, 4_000_000 // most)
                for first in range(0, part.num_rows, many):
                    db.register("these", part.slice(first, many))
                    sizes["pairs"] += duck.first(db, _SHARED)[0]
                    yield from bounded("pairs", "pair", summed)
                sizes["best"] += duck.first(db, f"INSERT INTO best SELECT lang, source, term, {_value('p', 'q')} AS value FROM part WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {int(top)}")[0]
                yield from bounded("best", "term", best)
            yield from taken("pair", summed)
            yield from taken("term", best)

    return thrifty(add)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in billionths, rounded down, plus 1; counts of any size stay exact. Null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.when(wide(total) + wide(terms) > 0, wide(total) + wide(terms))
    return (F.lit(1) + F.call_function("div", (wide(n) + 1) * F.lit(SCALE).cast("decimal(11,0)"), over)).cast("long")


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(documents: DataFrame, least_docs: int = 3, top: int = 200, piece: int = duck.PIECE) -> DataFrame:
    """lang, source, part, item, value, rank for ``documents`` (text, lang, source); a row is a document.

    Part ``pair``: each other source of the language with the divergence of the two term distributions. Part ``term``: the
    ``top`` terms that stand out in the source against its language. Terms of fewer than ``least_docs`` documents of a language are left
    out. All arithmetic is in integers. Ties go by item.

    Null texts, languages and sources are read as empty strings. Repeated rows count as often as they occur. A group without terms has its
    pairs all the same; in a language without kept terms their values are 0. No documents give no rows. Other columns are
    ignored, whatever their names. A long text is counted in parts.
    """
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_term_counter(piece), _COUNTED_DDL)
    # Terms first, as few sorted rows agree in them: nearly all comparisons end with their first bytes.
    shards = counted.repartition("lang", "term").sortWithinPartitions("term", "lang")
    kept = stored(shards.mapInArrow(_keeper(least_docs), _KEPT_DDL), "audit-kept")

    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_of"))
    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_of"), F.count_if("leads").alias("v"))
    groups = rows.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").fillna(0, ["n_of", "lang_of", "v"])
    groups = stored(groups.withColumn("p0", _share(F.lit(0), F.col("n_of"), F.col("v"))), "audit-groups")

    # The shards again, now with the totals of their groups.
    rated = join_table(kept, groups, ["lang", "source"], F.xxhash64("term"))
    rated = rated.select("lang", "term", "source", _share(F.col("n"), F.col("n_of"), F.col("v")).alias("p"), "p0", _share(F.col("lang_n"), F.col("lang_of"), F.col("v")).alias("q"))
    shards = rated.repartition("lang", "term").sortWithinPartitions("term", "lang")
    partial = stored(shards.mapInArrow(_adder(top), _PARTIAL_DDL), "audit-partial")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = join_table(groups, other, ["lang"], F.xxhash64("source")).where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("v") * F.coalesce(_far(F.col("p0"), F.col("q0")), F.lit(0))).alias("value"))
    often = stored(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "audit-often")
    often = join_table(often, groups, ["lang", "source"], F.xxhash64("n")).select("lang", "source", _share(F.col("n"), F.col("n_of"), F.col("v")).alias("p"), "p0", "m")
    first = join_table(often, other, ["lang"], F.xxhash64("source", "p")).where("source <> item")
    first = first.select("lang", "source", "item", (F.col("m") * (_far(F.col("p"), F.col("q0")) - _far(F.col("p0"), F.col("q0")))).alias("value"))
    here = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("g0"))
    second = join_table(often, here, ["lang"], F.xxhash64("source", "p")).where("source <> item")
    second = second.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (_far(F.col("g0"), F.col("p")) - _far(F.col("g0"), F.col("p0")))).alias("value"))
    wide = [x.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value")) for x in (base, first, second, partial.where("part = 'pair'"))]
    sums = wide[0].unionByName(wide[1]).unionByName(wide[2]).unionByName(wide[3]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    # Of the shards' best the best of each part of a group, then those of the group.
    terms = partial.where("part = 'term'").withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    parts = Window.partitionBy("lang", "source", "_salt").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("_place", F.row_number().over(parts)).where(F.col("_place") <= top)
    terms = terms.select("lang", "source", "item", F.col("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return told.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
