"""Blocks of HTML and Markdown files with byte ranges, and chunks of consecutive blocks.

A file is exploded into lines or markup tokens; running sums over them give bytes, states and block numbers,
and one aggregation makes the blocks. Nothing here runs in Python.
"""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tags that end a block.
BLOCK_TAGS = "p li tr h1 h2 h3 h4 h5 h6 div pre section table ul ol title header main br dt dd blockquote details summary".split()
#: White space of bytes, and of characters besides.
_ASCII = " \t\n\r\x0b\f"
_WHITE = r"[ \t\n\r\x0B\f\x1C-\x1F\x85\xA0  -     　]+"
CHUNK_TOKENS = 450


#: What may be a character reference, as in the standard library's ``html``; and one that ends with its sign.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_CLOSED = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});"


#: The named references of HTML, the common ones first as a map is searched from its start; those valid without a semicolon, longest first.
_NAMES = sorted(html5, key=lambda n: n.rstrip(";") not in ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot"))
_BARE = "^(?:" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True)) + ")"
# Numbers that HTML reads as other signs (those of windows-1252), and numbers of no character, which vanish.
_ONE_BYTE = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_OTHERS = {0: "\ufffd", 13: "\r"} | _ONE_BYTE
_NONE = [[1, 8], [11, 11], [14, 31], [127, 159], [0xFDD0, 0xFDEF]] + [[p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF] for p in range(17)]


def _map(entries: dict) -> Column:
    """A literal; neither the keys nor the values may hold the signs that stand between them."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entries.items())), F.lit("\x01"), F.lit("\x02"))


def _character(digits: Column, base: int) -> Column:
    """The character of a number in a reference."""
    short = F.ltrim(digits, F.lit("0"))
    n = F.conv(F.concat(F.lit("0"), F.substring(short, 1, 8)), base, 10).cast("long")
    wide = (F.length(short) > 7) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    none = functools.reduce(Column.__or__, [n.between(*ends) for ends in _NONE])
    # With a mark of byte order of its own, so that U+FEFF is a character.
    sign = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    return F.when(wide, "\ufffd").otherwise(F.coalesce(F.try_element_at(_map(_OTHERS), n.cast("string")), F.when(none, "").otherwise(sign)))


def _resolved(reference: Column, closed: bool) -> Column:
    """What the reference stands for, as ``html.unescape`` has it; itself if it is none."""
    digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1)
    names, name = _map({n: html5[n] for n in _NAMES}), F.substr(reference, F.lit(2))
    named = F.try_element_at(names, name)
    if not closed:
        bare = F.regexp_extract(name, _BARE, 0)
        named = F.coalesce(named, F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(name, F.length(bare) + 1))))
    number = F.when(F.lower(F.substring(reference, 3, 1)) == "x", _character(digits, 16)).otherwise(_character(digits, 10))
    return F.when(F.substring(reference, 2, 1) == "#", number).otherwise(F.coalesce(named, reference))


def plain(text: Column, closed: bool = False) -> Column:
    """Character references resolved (``closed``: only those that end with a semicolon), white space collapsed."""
    pattern = F.lit(_CLOSED if closed else _REFERENCE)
    has = F.contains(text, F.lit("&"))
    found = F.transform(F.when(has, F.regexp_extract_all(text, pattern, 0)), lambda r: _resolved(r, closed))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda t, r: F.concat(t, F.coalesce(r, F.lit(""))))
    return F.btrim(F.regexp_replace(F.when(has, F.array_join(pieces, "")).otherwise(text), _WHITE, " "), F.lit(" "))


def _running(rows: DataFrame, key: str, order: str, unit: str, more: Column | int = 0) -> DataFrame:
    """``rows`` with the byte where each unit starts and stops; ``more`` bytes stand between units."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length(unit) + more).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("stop", F.col("start") + F.octet_length(unit))


def _gathered(parts: DataFrame, key: str, order: str, between: str, closed: bool) -> DataFrame:
    """Parts (key, block, order, start, stop, part, is_heading) -> key, ordinal, start, stop, text, is_heading."""
    texts = F.sort_array(F.collect_list(F.struct(order, "part")))
    found = parts.groupBy(key, "block").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), texts.alias("_texts"), F.max("is_heading").alias("is_heading"))
    found = found.withColumn("text", plain(F.array_join(F.transform("_texts", lambda t: t["part"]), between), closed)).where("text <> ''")
    ordinal = (F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).alias("ordinal")
    return found.select(key, ordinal, "start", "stop", "text", "is_heading")


def md_blocks(files: DataFrame, key: str, body: str, closed: bool = False) -> DataFrame:
    """Paragraphs, single list items, table rows and code lines, and headings of Markdown and plain text."""
    lines = files.select(key, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1)).alias("line", "raw"))
    lines = _running(lines, key, "line", "raw", 1).withColumn("bare", F.btrim("raw", F.lit(_ASCII)))
    by = Window.partitionBy(key).orderBy("line")
    fence = F.startswith("bare", F.lit("```"))
    in_code = F.coalesce(F.sum(fence.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    heading = F.col("bare").rlike(r"^#{1,6}[ \t\n\r\x0B\f]")
    single = F.col("raw").rlike(r"^(?:[ \t\n\r\x0B\f]*(?:[-*+]|[0-9]+\.)[ \t\n\r\x0B\f]|\|)")
    kind = F.when(fence | (F.col("bare") == ""), "none").when(~F.col("in_code") & heading, "heading").when(F.col("in_code") | single, "single").otherwise("prose")
    lines = lines.withColumn("in_code", in_code).withColumn("kind", kind)
    # Prose goes on in the block of the prose line before; all else has a block of its own.
    goes_on = (F.col("kind") == "prose") & F.coalesce(F.lag("kind").over(by) == "prose", F.lit(False))
    lines = lines.withColumn("block", F.sum((~goes_on).cast("int")).over(by)).where("kind <> 'none'")
    part = F.when(F.col("kind") == "heading", F.regexp_replace("bare", r"^#{1,6}[ \t\n\r\x0B\f]+", "")).otherwise(F.col("raw"))
    return _gathered(lines.withColumn("part", part).withColumn("is_heading", F.col("kind") == "heading"), key, "line", "\n", closed)


def html_blocks(files: DataFrame, key: str, body: str, closed: bool = False) -> DataFrame:
    """Texts between tags that end a block; scripts and styles are skipped, the title is dropped."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?s)(<!--.*?-->|</?[a-zA-Z0-9]+[^>]*>|[^<]+|<)"), 1)
    rows = _running(files.select(key, F.posexplode(tokens).alias("place", "token")), key, "place", "token")
    by = Window.partitionBy(key).orderBy("place")
    rows = rows.withColumn("markup", F.startswith("token", F.lit("<")) & (F.length("token") > 1))
    rows = rows.withColumn("name", F.when(F.col("markup"), F.lower(F.regexp_extract("token", "^</?([a-zA-Z0-9]+)", 1))))
    opens = ~F.startswith("token", F.lit("</"))
    named = F.when(F.col("name").rlike("^(title|h[1-6])$"), F.when(opens, F.col("name")).otherwise(F.lit("")))
    rows = rows.select(
        key, "place", "start", "token", "markup",
        F.coalesce(F.last(F.when(F.col("name").isin("script", "style"), opens), ignorenulls=True).over(by), F.lit(False)).alias("silent"),
        F.coalesce(F.last(named, ignorenulls=True).over(by), F.lit("")).alias("within"),
        F.sum(F.coalesce(F.col("name").isin(*BLOCK_TAGS), F.lit(False)).cast("int")).over(by).alias("block"),
        F.sum(F.col("markup").cast("int")).over(by).alias("run"),
    )
    # A sign that opens no tag is text, so what stands between two tags may be several tokens.
    texts = rows.where("not markup and not silent and within <> 'title'").groupBy(key, "block", "run", "within")
    texts = texts.agg(F.min("start").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda t: t["token"]), "").alias("whole"))
    texts = texts.withColumn("part", F.btrim("whole", F.lit(_ASCII))).where("part <> ''")
    first = F.col("start") + F.octet_length("whole") - F.octet_length(F.ltrim("whole", F.lit(_ASCII)))
    texts = texts.withColumn("start", first.cast("long")).withColumn("stop", F.col("start") + F.octet_length("part"))
    return _gathered(texts.withColumn("is_heading", F.col("within") != ""), key, "run", " ", closed)


def with_heading(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks with the nearest heading at or before them (its ordinal and text)."""
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("is_heading"), F.struct("ordinal", "text"))
    return blocks.withColumn("_h", F.last(here, ignorenulls=True).over(before)).select(*blocks.columns, F.col("_h.ordinal").alias("heading_ordinal"), F.col("_h.text").alias("heading"))


def answer_blocks(blocks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """spans (key, from_byte, to_byte and others) with the blocks that they overlap, in order, and the heading of the first.

    ``blocks`` carry headings, see ``with_heading``. A span that meets no block has none, and no heading.
    """
    names = spans.columns
    met = spans.join(blocks.select(key, "ordinal", "start", "stop", "heading"), key, "left")
    inside = (F.col("start") < F.col("to_byte")) & (F.col("stop") > F.col("from_byte"))
    hit = F.when(inside, F.struct("ordinal", "heading"))
    out = met.groupBy(*names).agg(F.sort_array(F.collect_list(F.when(inside, F.col("ordinal")))).alias("ordinals"), F.min(hit).alias("_first"))
    return out.select(*names, "ordinals", F.col("_first.heading").alias("heading"))


def chunks(blocks: DataFrame, key: str, tokens: str = "n_tokens", most: int = CHUNK_TOKENS) -> DataFrame:
    """key, chunk, start, stop, text: consecutive blocks while they fit; a larger block is a chunk of its own."""
    rows = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col(tokens).cast("long").alias("n"), "start", "stop", "text"))).alias("_b"))
    start = F.struct(F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("of"))

    def step(acc, b):
        new = (acc["chunk"] < 0) | (acc["used"] + b["n"] > most)
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(chunk.cast("long").alias("chunk"), (F.when(new, 0).otherwise(acc["used"]) + b["n"]).cast("long").alias("used"), F.concat(acc["of"], F.array(chunk.cast("long"))).alias("of"))

    dealt = rows.withColumn("_of", F.aggregate("_b", start, step)["of"]).select(key, F.explode(F.arrays_zip("_b", "_of")).alias("x"))
    each = dealt.select(key, F.col("x._of").alias("chunk"), "x._b.*")
    ordered = each.groupBy(key, "chunk").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("_t"))
    return ordered.select(key, "chunk", "start", "stop", F.array_join(F.transform("_t", lambda t: t["text"]), "\n").alias("text"))
