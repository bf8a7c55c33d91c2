"""Byte-level BPE: encoding and decoding with a published table of ranks.

Pre-tokenisation uses no regular expression. Each code point gets a class from a
table; class and a look at the next few code points give a symbol. A small
automaton over the symbols says where a slice starts. Its transition functions
are closed under composition (a finite monoid), so they are scanned associatively:
blocks of the text are reduced column by column with one table lookup a symbol, the
block functions are composed, and a second pass marks the starts. The slices
then go through pair merging, each distinct slice once a worker while its cache, bounded
in slices and bytes, has room. The byte where each token starts is retained; decoding puts
each token's bytes there, without a loop over tokens.

Edge cases: a null text encodes as the empty text: no ids, no offsets, empty
bytes. Texts are processed whole, whatever their length. Repeated rows, null ids
and extra columns pass through as they are; ``ids`` and ``offsets`` are replaced
if the input has columns of these names. An empty table gives an empty table.
Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import BASES, slice_hashes

# Symbols of the automaton.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_MID, SPACE_LAST, BLANK_MID, BLANK_LAST, RESET = range(10)
# States: what the slice that is open holds so far. S_ANY: nothing that matters for the next symbol.
S_NONE, S_SPACE, S_LETTERS, S_NUMBERS, S_OTHERS, S_PEND1, S_PEND2, S_BLANKS = range(8)
#: Fixed values of the published pattern: endings after an apostrophe, by length.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
BLOCK = 64
#: Bytes up to which a slice is merged by looking over all its pairs.
SHORT_SLICE = 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a slice starts at this symbol."""
    if symbol == RESET:
        return S_NONE, True
    if state == S_PEND2:
        return S_PEND1, False
    if state == S_PEND1:
        return S_NONE, False  # whatever follows starts a slice
    if symbol in (LETTER, NUMBER, OTHER):
        run = (S_LETTERS, S_NUMBERS, S_OTHERS)[symbol]
        return run, not (state == run or state == S_SPACE)
    if symbol in (QUOTE1, QUOTE2):
        if state in (S_OTHERS, S_SPACE):  # inside a run of other signs
            return S_OTHERS, False
        return (S_PEND1 if symbol == QUOTE1 else S_PEND2), True
    last = symbol in (SPACE_LAST, BLANK_LAST)
    after = S_SPACE if symbol == SPACE_LAST else S_NONE if symbol == BLANK_LAST else S_BLANKS
    return after, last or state != S_BLANKS


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Functions on states reachable by composing symbols: (of symbol, compose table, apply table, next state, start)."""
    n_states, n_symbols = 8, 10
    nxt = np.array([[_step(s, y)[0] for s in range(n_states)] for y in range(n_symbols)], np.uint8)
    starts = np.array([[_step(s, y)[1] for s in range(n_states)] for y in range(n_symbols)], bool)
    elements: dict[tuple[int, ...], int] = {tuple(range(n_states)): 0}
    todo = [tuple(range(n_states))]
    while todo:
        f = todo.pop()
        for y in range(n_symbols):
            g = tuple(int(nxt[y][s]) for s in f)
            if g not in elements:
                elements[g] = len(elements)
                todo.append(g)
    functions = sorted(elements, key=elements.get)
    compose = np.array([[elements[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    of_symbol = np.array([elements[tuple(int(s) for s in nxt[y])] for y in range(n_symbols)], np.uint16)
    return of_symbol, compose, np.array(functions, np.uint8), nxt, starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, OTHER, SPACE_MID for U+0020, BLANK_MID for other white space."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    # The code points of the Unicode property White_Space.
    white = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = BLANK_MID
    out[0x20] = SPACE_MID
    return out


def slice_starts(points: np.ndarray, firsts: np.ndarray, join_space: bool = True) -> np.ndarray:
    """Positions in ``points`` (code points of several texts on end) where slices start.

    firsts: the positions where texts start, ascending; an empty text has none.
    join_space: whether one space belongs to the slice that follows it.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[points]
    blank = (kind == SPACE_MID) | (kind == BLANK_MID)
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    # White space that ends its run before more text is a symbol of its own.
    followed = np.zeros(n, bool)
    followed[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    if not join_space:
        kind = np.where(blank, np.uint8(BLANK_MID), kind)
    symbol = kind + followed
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        room = np.searchsorted(np.append(firsts, n), quotes, "right")
        left = np.append(firsts, n)[room] - quotes - 1
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS]) & (left >= 1)
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b)) & (left >= 2)
        symbol[quotes] = np.where(short, QUOTE1, np.where(long, QUOTE2, OTHER))
    of_symbol, compose, functions, nxt, starts = _monoid()
    # A text start: the state before it is S_NONE. The reset is composed into the symbol's own function.
    reset = compose[of_symbol[RESET]]
    by_first = np.concatenate([of_symbol, reset[of_symbol]])
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, RESET, np.uint8)
    padded[:n] = symbol
    padded[:n] += first[:n].view(np.uint8) * np.uint8(10)
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    total = np.zeros(rows, np.uint16)  # 0: the identity
    flat, width = compose.ravel(), compose.shape[1]
    for column in grid:
        total = flat[total.astype(np.int32) * width + by_first[column]]
    before = _exclusive_scan(total, flat, width)
    state = functions[before, S_NONE]
    mark = np.empty((BLOCK, rows), bool)
    table_next = np.concatenate([nxt, np.broadcast_to(nxt[:, S_NONE, None], nxt.shape)]).ravel()
    table_start = np.concatenate([starts, np.ones_like(starts)]).ravel()
    for j, column in enumerate(grid):
        at = column.astype(np.int32) * 8 + state
        mark[j] = table_start[at]
        state = table_next[at]
    return np.flatnonzero(mark.T.reshape(-1)[:n])


def _exclusive_scan(total: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """Composition of all that stands before each element, by doubling."""
    run = np.concatenate([np.zeros(1, np.uint16), total[:-1]])
    d = 1
    while d < len(run):
        run = np.concatenate([run[:d], flat[run[:-d].astype(np.int32) * width + run[d:]]])
        d *= 2
    return run


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank is merged first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    return _merged_short(piece, ranks) if len(piece) <= SHORT_SLICE else _merged_long(piece, ranks)


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """All pairs are looked over for each merge: the quicker way for words."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = len(ranks) + max(256, len(piece)) + (1 << 40)
    pairs = [ranks.get(a + b, never) for a, b in itertools.pairwise(parts)]
    while pairs:
        low = min(pairs)
        if low == never:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
    return [ranks[x] for x in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Neighbours are linked and candidates kept in a heap, so a slice of n bytes takes O(n log n)."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here
    back = list(range(-1, n - 1))  # start of the part before
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            back[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := back[i]) >= 0:
            r = ranks.get(piece[h:stop])
            if r is not None:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Merger(dict):
    """Ids by slice; a missing slice is merged, and kept if it is short. A full cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], room: int = 150_000) -> None:
        self.ranks, self.room = ranks, room

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(merge_pairs(piece, self.ranks))
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks, the cache of merged slices, and the tokens' bytes on end with their places."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        self.merger = _Merger(ranks)
        last = max(ranks.values(), default=-1)
        self.widths = np.zeros(last + 1, np.int64)  # an id without a token has no bytes
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        self.places = np.cumsum(self.widths) - self.widths
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte of its text at which each token starts; ids of texts on end, ``counts`` of each."""
        sizes = self.widths[ids]
        ahead = np.cumsum(sizes) - sizes
        first = np.cumsum(counts) - counts
        base = np.zeros(len(counts), np.int64)
        some = counts > 0
        base[some] = ahead[first[some]]
        return (ahead - np.repeat(base, counts)).astype(np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of one text: those of each token from its offset on."""
        sizes = self.widths[ids]
        # Places in the table minus places in the text are constant within a token.
        shift = np.repeat(self.places[ids] - offsets, sizes)
        return self.data[shift + np.arange(len(shift))].tobytes()


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One table at a time stays with a worker."""
    if path not in _held:
        _held.clear()
        _held[path] = Vocabulary(path)
    return _held[path]


def _ids_of_slices(data: bytes, cuts: np.ndarray, merger: _Merger) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the slices on end, and how many ids each slice has.

    Equal slices are found by two hashes and merged once.
    """
    raw = np.frombuffer(data, np.uint8)
    stops = np.append(cuts[1:], len(raw))
    key, check = (slice_hashes(raw, cuts, stops, b) for b in BASES)
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    if not np.array_equal(check[at][which], check):  # a collision: no sharing
        at = which = np.arange(len(cuts))
    pieces = map(data.__getitem__, map(slice, cuts[at].tolist(), stops[at].tolist()))
    lists = list(map(merger.__getitem__, pieces))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum()))
    counts = sizes[which]
    shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(counts) - counts)
    return flat[np.arange(int(counts.sum())) + np.repeat(shift, counts)], counts


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts on end, and how many ids each text has."""
    merger = vocabulary(path).merger
    joined = "".join(texts)
    data = joined.encode()
    if not data:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths)
    starts = slice_starts(points, (stops - lengths)[lengths > 0])
    cuts = starts
    if len(data) != len(points):  # to offsets in bytes
        wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        cuts = (np.cumsum(wide) - wide)[starts]
    flat, counts = _ids_of_slices(data, cuts, merger)
    total = np.concatenate([[0], np.cumsum(counts)])
    return flat, np.diff(total[np.searchsorted(starts, stops)], prepend=0)


def _chunks(texts: list[str], limit: int = 500_000) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > limit:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def _few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds little besides the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _coded(texts: list[str | None], path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of the texts: how many texts, their ids on end, offsets, ids of each text."""
    for chunk in _chunks([x or "" for x in texts]):
        flat, counts = encode_texts(chunk, path)
        yield len(chunk), flat, vocabulary(path).offsets(flat, counts), counts


def encode(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>) and ``offsets`` (array<int>: the byte where each token starts)."""
    keep = [f for f in df.schema.fields if f.name not in ("ids", "offsets")]
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*keep, T.StructField("ids", ints), T.StructField("offsets", ints)])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            done = 0
            for n, flat, offsets, counts in _coded(batch.column(text).to_pylist(), tokenizer_path):
                part = batch.slice(done, n)
                done += n
                edge = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(edge, pa.array(flat)), pa.ListArray.from_arrays(edge, pa.array(offsets))], names=[*names, "ids", "offsets"])

    return df.mapInArrow(run, schema)


def _decoded(vocabulary: Vocabulary, ids: pa.Scalar, offsets: pa.Scalar) -> bytes:
    if not ids.is_valid or not len(ids.values):
        return b""
    codes = ids.values.to_numpy()
    return vocabulary.decode(codes, offsets.values.to_numpy())


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of the tokens in ``ids`` at their ``offsets``; null ids give no bytes."""
    keep = [f for f in df.schema.fields if f.name != "decoded"]
    schema = T.StructType([*keep, T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer_path)
        for batch in _few(batches):
            out = [_decoded(table, x, y) for x, y in zip(batch.column(ids), batch.column(offsets), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.binary())], names=[*names, "decoded"])

    return df.mapInArrow(run, schema)


def _passed(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, list[str], list[T.StructField]]:
    """Columns to pass on under names that clash with nothing, the text last; and the fields of the result."""
    fields = [df.schema[c] for c in keep]
    inner = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    return inner, [f.name for f in fields], fields


def encode_checked(df: DataFrame, tokenizer_path: str, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns with ids, n_tokens and decodes: whether the ids decode to the text, found where they are made."""
    inner, names, fields = _passed(df, keep, text)
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("decodes", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer_path)
        for batch in _few(batches):
            done, texts = 0, batch.column("t").to_pylist()
            for n, flat, offsets, counts in _coded(texts, tokenizer_path):
                edge = np.concatenate([[0], np.cumsum(counts)])
                same = [table.decode(flat[a:b], offsets[a:b]) == (x or "").encode() for x, (a, b) in zip(texts[done : done + n], itertools.pairwise(edge), strict=True)]
                part = batch.slice(done, n)
                done += n
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat)), pa.array(counts, pa.int64()), pa.array(same)], names=[*names, "ids", "n_tokens", "decodes"])

    return inner.mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Digests of what encoding and then decoding give: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    inner, names, fields = _passed(df, ("doc_id",), text)
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer_path)
        for batch in _few(batches):
            done = 0
            for n, flat, offsets, counts in _coded(batch.column("t").to_pylist(), tokenizer_path):
                edge = np.concatenate([[0], np.cumsum(counts)])
                ids, texts = [], []
                for a, b in itertools.pairwise(edge):
                    ids.append(hashlib.sha256(" ".join(map(str, flat[a:b].tolist())).encode()).hexdigest())
                    texts.append(hashlib.sha256(table.decode(flat[a:b], offsets[a:b])).hexdigest())
                part = batch.slice(done, n)
                done += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return inner.mapInArrow(run, schema)
