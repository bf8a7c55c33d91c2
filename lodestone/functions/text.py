"""Text columns: normal form, tokens, query terms, byte segments. All built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_BYTES = 4096
EXPRESSION_BYTES = 4096
#: ASCII code points that are neither letters nor digits.
ASCII_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalized(text: Column) -> Column:
    """Without one leading byte order mark; CRLF and CR as LF."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


# Fixed value: the one Latin letter with marks that keeps them.
KEPT_MARKS = "\u01e1"


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters in lower case and what they become: Latin ones lose their marks, others of equal case meaning become one. Then marks that go.

    From Unicode's data: a mark goes if a Latin letter's canonical decomposition has it.
    """
    marked, plain, marks = [], [], set()
    for cp in range(0x80, 0x2000):
        letter = chr(cp)
        folded = letter.casefold()
        folded = folded if len(folded) == 1 else letter
        base = unicodedata.normalize("NFD", folded)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            marks.update(base[1:])
            folded = folded if folded in KEPT_MARKS else base[0]
        if letter.isalpha() and letter == letter.lower() and folded != letter:
            marked.append(letter)
            plain.append(folded)
    return "".join(marked + sorted(marks)), "".join(plain)


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters, numbers and private-use characters, in lower case, without the marks of Latin letters, whether they stand alone or not."""
    letters, become = _folding()
    return F.regexp_extract_all(F.translate(F.lower(text), letters, become), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def query_terms(query: Column) -> Column:
    """Terms of a query: split at ASCII signs only, trimmed, lower case, no empty ones."""
    edge = r"^[\p{Z}\x{85}]+|[\p{Z}\x{85}]+$"
    cut = F.transform(F.split(query, ASCII_BREAKS), lambda t: F.lower(F.regexp_replace(t, edge, "")))
    return F.filter(cut, lambda t: t != "")


def capped_terms(terms: Column, distinct: bool = False, limit: int = EXPRESSION_BYTES) -> Column:
    """The longest prefix whose quoted terms, joined by " OR ", take at most ``limit`` bytes; the first term always stays."""
    terms = F.array_distinct(terms) if distinct else terms
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, term: Column) -> Column:
        size = acc["size"] + F.octet_length(term) + 2 + F.when(F.size(acc["kept"]) > 0, 4).otherwise(0)
        over = acc["full"] | ((size > limit) & (F.size(acc["kept"]) > 0))
        return F.struct(F.when(over, acc["size"]).otherwise(size).cast("long").alias("size"), over.alias("full"), F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(term))).alias("kept"))

    return F.aggregate(terms, start, step, lambda acc: acc["kept"])


def expression(terms: Column) -> Column:
    """Quoted terms joined by OR."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def _continues(data: Column, at: Column) -> Column:
    return F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")


def fixed_cuts(data: Column, size: int = SEGMENT_BYTES) -> Column:
    """Ends of the segments of UTF-8 ``data``: every ``size`` bytes, moved back to a character's start."""
    length = F.octet_length(data)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(length / (size - 3)).cast("int")))

    def step(acc: Column, _: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        stop = last + size
        back = F.when(~_continues(data, stop), 0).when(~_continues(data, stop - 1), 1).when(~_continues(data, stop - 2), 2).otherwise(3)
        nxt = F.when(stop >= length, length).otherwise(stop - back)
        return F.when(last < length, F.concat(acc, F.array(nxt))).otherwise(acc)

    return F.aggregate(steps, F.array().cast("array<int>"), step)


def format_bytes(n: Column) -> Column:
    """In the largest unit that divides the number."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, power in (("KiB", 10), ("MiB", 20), ("GiB", 30)):
        out = F.when((n != 0) & (n % (1 << power) == 0), F.concat(F.floor(n / (1 << power)).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncated(text: Column, limit: int = 512) -> Column:
    """At most ``limit`` bytes, cut at a character's start."""
    data = text.cast("binary")
    back = F.when(~_continues(data, F.lit(limit)), 0).when(~_continues(data, F.lit(limit - 1)), 1).when(~_continues(data, F.lit(limit - 2)), 2).otherwise(3)
    return F.when(F.octet_length(data) <= limit, text).otherwise(F.substring(data, F.lit(1), F.lit(limit) - back).cast("string"))


def rough_tokens(text: Column) -> Column:
    """Words and single signs, as a stand-in for a model's token count."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def line_of(text: Column, byte: Column) -> Column:
    """Line number (from 1) of a byte offset."""
    before = F.substring(text.cast("binary"), F.lit(1), byte).cast("string")
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


# The words that the baseline leaves out.
STOP_WORDS = "the a an of to in on for and or is are was be with by at as it this that from".split()


def baseline_expression(text: Column) -> Column:
    """The OR of the distinct ASCII terms that aren't stop words, in order; null without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    kept = F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "))
