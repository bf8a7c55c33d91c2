"""Passages: blocks of lines grouped up to a size. A cut depends on the cut before it, so texts go through Arrow batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PASSAGE_BYTES = 1024
MOST_PASSAGES = 65_536
# Fixed values of the passage format: what starts a heading, a list item, a fence; a blank line has none but these signs.
_SPACES = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})(.*)", re.S)
_SHAPES = [
    ("heading", re.compile(r" {0,3}#{1,6}(?:[ \t\n]|$)")),
    ("item", re.compile(r"[-*+][ \t]|[0-9]{1,9}[.)][ \t]")),
    ("row", re.compile(r"[^|]*\|")),
]


def _shape(line: bytes) -> str:
    """blank, heading, item, row or prose, by how the line looks."""
    text = line.decode("utf-8", "replace")
    if not text.strip(_SPACES):
        return "blank"
    # An item's mark is looked for where trailing white space is off, so a bare mark is none.
    looks = {"heading": text, "item": text.strip(_SPACES), "row": text}
    return next((name for name, shape in _SHAPES if shape.match(looks[name])), "prose")


def _marked(lines: list[bytes]) -> Iterator[tuple[str, bool]]:
    """Shape of each line, and whether it starts a block if no blank line stands before it."""
    fence: tuple[bytes, int] | None = None  # the sign and length of the fence that is open
    held = "blank"  # shape of the block that is open
    for line in lines:
        mark = _FENCE.match(line)
        if fence:
            yield "code", False
            if mark and mark[1][:1] == fence[0] and len(mark[1]) >= fence[1] and not mark[2].strip(b" \t\n"):
                fence, held = None, "closed"
            continue
        shape = _shape(line)
        if shape == "blank":
            yield shape, False
            held = "closed" if held != "blank" else held
        elif mark:
            yield "code", True
            fence = mark[1][:1], len(mark[1])
        else:
            apart = held in ("blank", "closed", "heading") or shape == "heading" or (shape == "row") != (held == "row") or shape == "item" != held
            yield shape, apart
            held = shape if apart else held


def blocks(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, heading) of the blocks, which tile the text; blank lines belong to the block before, or to the first."""
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    edges = [0, *itertools.accumulate(map(len, lines))]
    marked = list(_marked(lines))
    starts = [i for i, (_, starts) in enumerate(marked) if starts]
    for n, i in enumerate(starts):
        stop = starts[n + 1] if n + 1 < len(starts) else len(lines)
        yield edges[i if n else 0], edges[stop], marked[i][0] == "heading"
    if lines and not starts:
        yield 0, len(data), False


def _cut(data: bytes, start: int, stop: int, size: int) -> int:
    """Where a piece of an oversized block ends: after the last line end, else after the last blank, else before a character."""
    if stop - start <= size:
        return stop
    piece = data[start : start + size]
    if (at := piece.rfind(b"\n")) >= 0 or (at := max(piece.rfind(b" "), piece.rfind(b"\t"))) >= 0:
        return start + at + 1
    cut = start + size
    while cut > start and data[cut] & 0xC0 == 0x80:
        cut -= 1
    return cut


def passages(data: bytes, size: int = PASSAGE_BYTES) -> list[tuple[int, int]]:
    """Byte ranges that tile the text: blocks are grouped while they fit, a heading starts a group."""
    out: list[tuple[int, int]] = []
    held = 0  # where the open group starts
    for at, stop, heading in blocks(data):
        if at > held and (heading or stop - held > size):
            out.append((held, at))
            held = at
        if stop - at > size:
            while held < stop:
                cut = _cut(data, held, stop, size)
                out.append((held, cut))
                held = cut
    if held < len(data):
        out.append((held, len(data)))
    if len(out) > MOST_PASSAGES:
        raise ValueError("too many passages")
    return out


def segment_passages(items: DataFrame, body: str = "body", size: int = PASSAGE_BYTES) -> DataFrame:
    """One row per passage: the items' columns without the body, ordinal, start, stop, text."""
    keep = [f for f in items.schema.fields if f.name != body]
    names = [f.name for f in keep]
    more = [T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, ordinal, starts, stops, texts = [], [], [], [], []
            for i, text in enumerate(b.column(b.schema.get_field_index(body)).to_pylist()):
                data = (text or "").encode()
                for k, (s, e) in enumerate(passages(data, size)):
                    which.append(i)
                    ordinal.append(k)
                    starts.append(s)
                    stops.append(e)
                    texts.append(data[s:e].decode())
            at = pa.array(which, pa.int32())
            arrays = [b.column(b.schema.get_field_index(n)).take(at) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ordinal, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(texts, pa.string())], names=[*names, "ordinal", "start", "stop", "text"])

    return items.mapInArrow(run, T.StructType([*keep, *more]))
