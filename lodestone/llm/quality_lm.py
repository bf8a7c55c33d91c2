"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character class from the ORDER - 1 before it. Classes: the letters a to z,
accented lower-case letters, capitals, digits, white space, frequent signs each their own, and the letters and
marks of other scripts each their own up to U+1A23 (above, those with equal remainders by SCRIPTS share one).
A fifth of the documents that the labels call good is held out. The model is fitted on all others, or on about ``sample`` of
each language where a caller asks for that. Counts, continuation counts, the three discounts of each
order and the weights of the lower orders all come from grouped counts and joins
in which n-grams are spread over shards by hash.

Scoring covers all documents and their whole texts. Documents are dealt into blocks; each block
lists its distinct n-grams, these join the model's sharded tables (probability where the n-gram was
seen, else back-off weights of its shorter contexts), and the answers meet the documents of the block
again. What moves is text once and a block's distinct n-grams, however large the model is.

``perplexity`` is a document's plain one. What is judged is ``shrunk``, the perplexity drawn towards the language's typical one as if PRIOR more
characters of typical text followed, so short texts need to be much stranger. A document is rejected if that is above ``threshold``,
MARGIN times ``quantile``: the QUANTILE of the same measure over the trusted documents of its language that the model was not fitted on. Languages with fewer than LEAST such documents, and null languages, are judged by all of them.

Edge cases: null, empty texts have no perplexity and are kept. Texts of any length are scored whole. Without trusted documents
nothing is rejected; an empty table gives an empty table. Repeated rows are scored each. Null ids are scored, never trusted. Extra columns of any names
can be kept; ``judge`` replaces those that have a result's name, ``accepted`` none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_table, release, stored, thrifty

ORDER = 5
#: QUANTILE and MARGIN by rates measured on good and bad labels; the README has them.
QUANTILE, MARGIN, PRIOR, LEAST = 0.995, 1.05, 60, 50
#: Bytes of text in a block of documents.
BLOCK = 24 << 20

# The classes that have a number of their own after the letters.
SIGNS = " .,-'\"|!?;:()/*$%#&@_<>=+"
CAPITAL, ACCENTED, DIGIT, OTHER = 26, 27, 28, 29
FIRST_SIGN = 30
FIRST_SCRIPT = FIRST_SIGN + len(SIGNS)
#: Classes for letters from U+0250 on; as many as leave the code of an n-gram of order 5 within 63 bits.
SCRIPTS = 6100
ALPHABET = FIRST_SCRIPT + SCRIPTS + 1
#: No letters have been assigned from here on.
LAST = 0x323B0
#: Stands before the first character.
START = ALPHABET - 1


def _class_table() -> np.ndarray:
    out = np.full(LAST + 1, OTHER, np.uint16)
    for cp in range(0x250):
        c = chr(cp)
        if "a" <= c <= "z":
            out[cp] = cp - 97
        elif c.isupper():
            out[cp] = CAPITAL
        elif c.isalpha():
            out[cp] = ACCENTED
        elif c.isdigit():
            out[cp] = DIGIT
        elif c.isspace():
            out[cp] = FIRST_SIGN
    for i, c in enumerate(SIGNS):
        out[ord(c)] = FIRST_SIGN + i
    for cp in range(0x250, LAST):
        kind = unicodedata.category(chr(cp))
        if kind == "Lu":
            out[cp] = CAPITAL
        elif kind[0] in "LM":
            out[cp] = FIRST_SCRIPT + (cp - 0x250) % SCRIPTS
        elif kind == "Nd":
            out[cp] = DIGIT
        elif kind[0] == "Z":
            out[cp] = FIRST_SIGN
    return out


_CLASSES = _class_table()


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-gram that ends at each character, texts on end, and the texts' lengths."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _CLASSES[np.minimum(points, LAST)].astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths)
    place = np.arange(len(kind)) - np.repeat(stops - lengths, lengths)
    code = kind.copy()
    for back in range(1, order):
        earlier = np.full(len(kind), START, np.int64)
        earlier[back:] = kind[: max(len(kind) - back, 0)]
        earlier[place < back] = START
        code += earlier * ALPHABET**back
    return code, lengths


#: Characters whose n-grams are made at once.
AT_ONCE = 1 << 18


def stretches(texts: list[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of the n-grams of some texts at a time, on end; which texts they belong to, and how many each has.

    A long text comes in several parts; each begins with the characters that its first n-grams reach back to.
    """
    held: list[tuple[int, str, int]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, lengths = grams([part for _, part, _ in held], order)
        back = np.array([n for *_, n in held], np.int64)
        if back.any():
            place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            code = code[place >= np.repeat(back, lengths)]
        return code, np.array([i for i, *_ in held], np.int64), lengths - back

    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), AT_ONCE):
            back = min(at, order - 1)
            held.append((i, text[at - back : at + AT_ONCE], back))
            size += len(held[-1][1])
            if size >= AT_ONCE:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for code, _, _ in stretches(b.column("text").to_pylist(), order):
                value, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return thrifty(run)


def fit(trusted: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Tables by order, 1 first: gram, p (interpolated probability), and for its use as a context ``back`` (weight of the lower order).

    trusted: a ``text`` column.
    """
    full = trusted.select("text").mapInArrow(_counts(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {order: stored(full, "grams")}
    for k in range(order - 1, 0, -1):
        # Continuation counts: how many different classes stand before.
        counts[k] = stored(counts[k + 1].groupBy(F.pmod("gram", F.lit(ALPHABET**k)).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}")
    tables: list[DataFrame] = []
    for k in range(1, order + 1):
        # Of four numbers each, whatever the text.
        seen = {int(r["n"]): int(r["k"]) for r in counts[k].where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
        n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d1, d2, d3 = (min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].withColumn("context", F.expr(f"gram div {ALPHABET}")).withColumn("d", discount)
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("held"))
        sums = sums.select("context", "total", (F.col("held") / F.col("total")).alias("back"))
        rows = rows.join(sums, "context").withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if k == 1:
            below = rows.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            below = rows.withColumn("suffix", F.pmod("gram", F.lit(ALPHABET ** (k - 1)))).join(tables[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        tables.append(stored(below.select("gram", "context", "back", (F.col("own") + F.col("back") * F.col("lower")).alias("p")), f"model-{k}"))
    return tables


def answer(asked: DataFrame, tables: list[DataFrame], order: int = ORDER) -> DataFrame:
    """asked (gram and others) with ``logp``: the longest seen end of the n-gram, times the weights of the contexts above it."""
    weight, out = F.lit(1.0), asked
    p = F.lit(None).cast("double")
    for k in range(order, 0, -1):
        table = tables[k - 1]
        gram = F.pmod("gram", F.lit(ALPHABET**k))
        out = out.withColumn(f"_g{k}", gram).join(table.select(F.col("gram").alias(f"_g{k}"), F.col("p").alias(f"_p{k}")), f"_g{k}", "left")
        p = F.coalesce(p, weight * F.col(f"_p{k}"))
        if k > 1:
            backs = table.groupBy(F.col("context").alias(f"_c{k}")).agg(F.first("back").alias(f"_b{k}"))
            out = out.withColumn(f"_c{k}", F.expr(f"_g{k} div {ALPHABET}")).join(backs, f"_c{k}", "left")
            weight = weight * F.coalesce(F.col(f"_b{k}"), F.lit(1.0))
    unseen = tables[0].agg(F.first("back").alias("_b1"))
    out = out.crossJoin(F.broadcast(unseen))  # one row
    p = F.coalesce(p, weight * F.coalesce("_b1", F.lit(1.0)) / ALPHABET)
    return out.select(*asked.columns, F.log(p).alias("logp"))


def _bundled(names: list[str], limit: int = 16 << 20):
    """Rows (block, columns) -> (block, bundle): the rows of a block together, compressed, as text is most of what moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for s, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                part = table.take(pa.array(order[s:e])).select(names)
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([block[order[s]]], pa.int32()), pa.array([pack.compress(sink.getvalue())], pa.binary())], names=["block", "bundle"])

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > limit:
                yield from flush()
        if held and sum(x.num_rows for x in held):
            yield from flush()

    return run


def _opened(bundle: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of a bundle, some at a time."""
    data = zstandard.ZstdDecompressor().decompressobj().decompress(bundle)
    table = pa.ipc.open_stream(data).read_all()
    for at in range(0, table.num_rows, 256):
        yield from table.slice(at, 256).combine_chunks().to_batches()


def _asked(order: int):
    """A partition's whole blocks -> their distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, bundle in zip(b.column("block").to_pylist(), b.column("bundle").to_pylist(), strict=True):
                mine = found.setdefault(block, [])
                for rows in _opened(bundle):
                    mine += [np.unique(code) for code, _, _ in stretches(rows.column("text").to_pylist(), order)]
                    if len(mine) > 8:
                        mine[:] = [np.unique(np.concatenate(mine))]
        for block, codes in found.items():
            value = np.unique(np.concatenate([np.empty(0, np.int64), *codes]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), block, np.int32)), pa.array(value)], names=["block", "gram"])

    return run


def _scored(order: int, names: list[str]):
    """A block's bundles and answers -> documents with nll and characters."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, logp = right.column("gram").to_numpy(), right.column("logp").to_numpy()
        by = np.argsort(gram)
        gram, logp = gram[by], logp[by]
        out = []
        for bundle in left.column("bundle"):
            for b in _opened(bundle.as_py()):
                texts = b.column("text").to_pylist()
                nll = np.zeros(len(texts))
                for code, rows, counts in stretches(texts, order):
                    cost = -logp[np.searchsorted(gram, code)]
                    np.add.at(nll, rows, np.add.reduceat(cost, np.cumsum(counts) - counts))
                lengths = np.fromiter((len(x or "") for x in texts), np.int64, len(texts))
                out.append(pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(nll), pa.array(lengths)], names=[*names, "nll", "n_scored"]))
        release()
        return pa.Table.from_batches(out)

    return call


def score(docs: DataFrame, tables: list[DataFrame], keep: list[str], blocks: int, order: int = ORDER) -> DataFrame:
    """``keep`` columns of docs (which has ``text`` and others) with nll (nats) and n_scored (characters)."""
    names = ["text", *(c for c in keep if c != "text")]
    # Of few columns: what Spark infers about an expression of many that have a second name grows with the power of their number.
    inner = docs.select(F.pmod(F.xxhash64(*names[:3]), F.lit(blocks)).cast("int").alias("block"), *names)
    dealt = inner.mapInArrow(thrifty(_bundled(names)), "block int, bundle binary").repartition(blocks, "block")
    asked = dealt.mapInArrow(thrifty(_asked(order)), "block int, gram long")
    answers = asked.join(answer(asked.select("gram").distinct(), tables, order), "gram").select("block", "gram", "logp")
    fields = ", ".join([*(f"`{n}` {inner.schema[n].dataType.simpleString()}" for n in keep), "nll double, n_scored long"])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(order, keep), fields)


RESULTS = ("n_scored", "perplexity", "shrunk", "quantile", "threshold", "rejected")


#: Bits of the bitmap of ids, and of one row of it (fixed by Spark's ``bitmap_construct_agg``): of one size, whatever the labels.
MARKS, ROW_MARKS = 1 << 25, 1 << 15


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (id and others) whose id is among ``ids`` (distinct ones).

    A bitmap of hashed ids tells most others in place, so that their texts don't move; the join decides on the rest.
    """
    mark = F.pmod(F.xxhash64(F.lit("mark"), "id"), F.lit(MARKS))
    row, bit = F.floor(mark / ROW_MARKS), F.pmod(mark, F.lit(ROW_MARKS)).cast("int")
    marks = ids.groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("_row", row).join(F.broadcast(marks), "_row").where(F.getbit(byte, bit % 8) == 1)
    return found.select(*docs.columns).join(ids, "id")


def _drawn(fits: DataFrame, sample: int) -> DataFrame:
    """Ids of about ``sample`` rows (id, lang) of each language: by hash, so that the same ones are drawn each time and no task has a language to itself."""
    fits = stored(fits, "fits")
    shares = stored(fits.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")).select(F.coalesce("lang", F.lit("")).alias("language"), F.col("lang").isNull().alias("none"), "share"), "sample-shares")
    draw = F.pmod(F.xxhash64(F.lit("trusted"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    named = fits.select("id", F.coalesce("lang", F.lit("")).alias("language"), F.col("lang").isNull().alias("none"))
    return stored(join_table(named, shares, ["language", "none"], F.xxhash64("id")).where(draw < F.col("share")).select("id").distinct(), "trusted")


#: How far a rank of ``percentile_approx`` may be off, as a share of the rows.
OFF = 1e-5


def _quantiles(rows: DataFrame, by: str, value: str, quantile: float) -> DataFrame:
    """by, n, limit: of each group of n rows the value at rank ceil(quantile * n), exactly.

    Memory is bounded, as the rows grow with the labels: two estimates enclose the value, and only what lies between them is put in order.
    """
    ends = F.percentile_approx(value, [max(quantile - 2 * OFF, 0.0), min(quantile + 2 * OFF, 1.0)], round(1 / OFF))
    groups = stored(rows.groupBy(by).agg(F.count("*").alias("n"), ends.alias("_ends")), "enclosed")
    met = join_table(rows, groups, [by], F.xxhash64(value)).where(F.col(value) <= F.col("_ends")[1])
    at = F.when(F.col(value) < F.col("_ends")[0], F.lit(float("-inf"))).otherwise(F.col(value))
    counts = met.groupBy(by, "n", at.alias("_at")).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(by).orderBy("_at"))
    return counts.withColumn("_upto", upto).where(F.col("_upto") >= F.ceil(F.lit(quantile) * F.col("n"))).groupBy(by, "n").agg(F.min("_at").alias("limit"))


def _judged(documents: DataFrame, labels: DataFrame, keep: list[str], doc_id: str, text: str, lang: str, sample: int | None, quantile: float, margin: float, order: int) -> DataFrame:
    """Columns c0, c1, ... for those of ``keep``, and RESULTS."""
    passed = [f"c{i}" for i in range(len(keep))]
    inner = documents.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"), *[F.col(c).alias(p) for c, p in zip(keep, passed, strict=True) if c != text])
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    good = stored(good.withColumn("held_out", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)) == 0), "good")
    chosen = good.where("not held_out").select("id")
    if sample is not None:
        chosen = _drawn(inner.select("id", "lang").join(chosen, "id"), sample)
    tables = fit(_picked(inner.select("id", "text"), chosen), order)
    size = inner.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(-(-int(size) // BLOCK), 1)
    carried = ["id", "lang", *(p for p in passed if p in inner.columns), *(["text"] if text in keep else [])]
    scored = stored(score(inner, tables, carried, blocks, order), "scored")
    held = scored.where("n_scored > 0").select("id", "lang", "nll", "n_scored").join(good.join(chosen, "id", "left_anti").select("id"), "id")
    held = stored(held, "held-out")
    mean = F.sum("nll") / F.sum("n_scored")
    middle = stored(held.groupBy("lang").agg(F.count("*").alias("n"), mean.alias("mean")).where((F.col("n") >= LEAST) & F.col("lang").isNotNull()).select("lang", "mean"), "language-means")
    everything = held.agg(mean.alias("all")).select(F.coalesce("all", F.lit(0.0)).alias("all"))

    def shrink(rows: DataFrame) -> DataFrame:
        with_mean = join_table(rows, middle, ["lang"], F.xxhash64("id", "nll"), "left").crossJoin(F.broadcast(everything))  # one row
        return with_mean.withColumn("shrunk", F.when(F.col("n_scored") > 0, F.exp((F.col("nll") + PRIOR * F.coalesce("mean", "all")) / (F.col("n_scored") + PRIOR)))).drop("mean", "all")

    known = stored(shrink(held).select("lang", "shrunk"), "trusted-shrunk")
    by_lang = stored(_quantiles(known.where("lang is not null"), "lang", "shrunk", quantile).where(F.col("n") >= LEAST).select("lang", "limit"), "language-quantiles")
    overall = _quantiles(known.withColumn("whole", F.lit(0)), "whole", "shrunk", quantile).agg(F.max("limit").alias("limit_all"))
    out = join_table(shrink(scored), by_lang, ["lang"], F.xxhash64("id", "nll"), "left").crossJoin(F.broadcast(overall))  # one row
    out = out.withColumn("quantile", F.coalesce("limit", "limit_all")).withColumn("threshold", F.lit(margin) * F.col("quantile"))
    out = out.withColumn("perplexity", F.when(F.col("n_scored") > 0, F.exp(F.col("nll") / F.col("n_scored"))))
    out = out.withColumn("rejected", F.coalesce(F.col("shrunk") > F.col("threshold"), F.lit(False)))
    return out.select(*[F.col("text").alias(p) if c == text else F.col(p) for c, p in zip(keep, passed, strict=True)], *RESULTS)


def judge(
    documents: DataFrame,
    labels: DataFrame,
    keep: list[str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int | None = None,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    order: int = ORDER,
) -> DataFrame:
    """``keep`` columns (default: id and language) with n_scored, perplexity, shrunk, quantile, threshold and rejected."""
    keep = keep or [doc_id, lang]
    out = _judged(documents, labels, keep, doc_id, text, lang, sample, quantile, margin, order)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in RESULTS], *RESULTS)


def accepted(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN, order: int = ORDER) -> DataFrame:
    """Rows of ``documents`` that aren't rejected, with their columns as they are."""
    out = _judged(documents, labels, documents.columns, doc_id, text, lang, sample, quantile, margin, order)
    return out.where("not rejected").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])
