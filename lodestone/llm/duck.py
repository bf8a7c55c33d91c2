"""DuckDB inside a Spark task: in memory, one thread, a bounded size, no files of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one statement tokenises at most, but for a word that is longer.
PIECE = 1 << 20
#: A to Z lower-cased, other letters left as they are.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def connect(memory: str = "700MB") -> duckdb.DuckDBPyConnection:
    settings = {"threads": 1, "memory_limit": memory, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}
    return duckdb.connect(":memory:", config=settings)


def first(db: duckdb.DuckDBPyConnection, query: str) -> tuple:
    """The first row, with all others read: a connection does nothing else before."""
    return db.execute(query).fetchall()[0]


def _cuts(text: str, word: re.Pattern, gap: re.Pattern, ahead: int, most: int) -> Iterator[tuple[str, int]]:
    """Parts of a text that end between words, each with up to ``ahead`` words of what follows, and their number."""
    start = 0
    while start < len(text):
        found = gap.search(text, start + most) if start + most < len(text) else None
        stop = found.start() if found else len(text)
        end, n = stop, 0
        while n < ahead and (next_ := word.search(text, end)):
            end, n = next_.end(), n + 1
        yield text[start:end], n
        start = stop


def statements(texts: pa.Array, gap: str, ahead: int = 0, most: int = PIECE) -> Iterator[pa.Table]:
    """Tables (row, text, ahead) that hold all of ``texts``, nulls as empty ones, by at most about ``most`` characters.

    ``gap`` is the class, in brackets, of characters between words, before letters are lower-cased. A text that is longer lies in several rows, cut between words. The last ``ahead`` words of such a
    part begin the next one: what starts at them belongs there.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    words, gaps = re.compile(f"[^{gap[1:]}+"), re.compile(gap)
    first, held = 0, 0

    def whole(a: int, b: int) -> pa.Table:
        n = b - a
        return pa.table({"row": pa.array(range(a, b), pa.int32()), "text": texts.slice(a, n), "ahead": pa.array([0] * n, pa.int32())})

    for i, size in enumerate(sizes):
        if held + size > most and i > first:
            yield whole(first, i)
            first, held = i, 0
        if size > most:
            for part, n in _cuts(texts[i].as_py(), words, gaps, ahead, most):
                yield pa.table({"row": pa.array([i], pa.int32()), "text": [part], "ahead": pa.array([n], pa.int32())})
            first, held = i + 1, 0
        else:
            held += size
    if first < len(sizes):
        yield whole(first, len(sizes))
