"""Removal of byte strings that occur more than once, by column-wise construction of a collection transform.

A string of ``length`` bytes that starts in more than one place (of any document, its own included) is
removed wherever it starts; overlapping removals join. Matches never cross documents.

Route. Every window of ``length`` bytes has an anchor: the smallest hash among its substrings
of ANCHOR bytes, leftmost if tied. Equal windows have equal anchors at equal offsets, so a
run of windows with one anchor place (a piece) need only be compared with pieces of the same anchor.
Anchors that occur once are dropped before any text moves, and pieces with
equal bytes are decided by count: all their windows repeat. What is left, the distinct pieces of
shared anchors, moves once, aligned at the anchor.

Construction. The pieces of one task form a collection. Each round inserts one symbol per piece,
the column one to the left: from the order of the suffixes of the last round and
the symbols before them (the collection's Burrows-Wheeler column) a stable count gives the
next order, and common prefixes are updated by range minima over the last round's. As equal windows stand
in equal columns, a column's order is all the next one needs; finished columns (order and
common prefixes) go to sequential external files, and one sequential pass over these marks the
windows whose common prefix with a neighbour reaches ``length``.

Hot groups. Where an anchor has more than GROUP distinct pieces, these are split by further bytes: cut into stretches of STRETCH windows
at fixed distances from the anchor, and grouped by their core, the bytes that all windows of a stretch share. Stretches whose bytes recur
repeat whole, a core that is found with one content only holds no repeats, and the distinct stretches of any other core are a collection
that goes through the same construction. A core with more than GROUP of them, the edge of a passage that very many documents share,
is split further to its single windows, where nothing is left to sort: equal ones are found by count. Digests have 128 bits, are
counted before they move, and are taken as equality; no task holds a crowded group.

Edge cases: null counts as the empty text. Documents shorter than ``length`` keep all bytes.
Rows with equal ids are documents of their own: repeated rows repeat each other's bytes. Null
ids are kept. Texts of any length are taken whole, in blocks. Extra columns of the input, whatever their names, are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_key, stored, thrifty
from .rolling import mix

ANCHOR = 32
GROUP = 2048
#: Bytes of text that are scanned, and of pieces that are sorted, at once.
SCAN, COLLECTION = 1 << 20, 24 << 20
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor place: first window, the place, the anchor's hash."""
    size = 1 << min(ANCHOR, length).bit_length() - 1
    n, windows, span = len(data), len(data) - length + 1, length - size + 1
    with np.errstate(over="ignore"):
        h = mix(data.astype(np.uint64) + np.uint64(1))
        width, factor = 1, _MULTIPLIER
        while width < size:
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
            width *= 2
        h = mix(h)
    # The hash's upper 40 bits, then the place: a minimum of these is the leftmost smallest.
    low = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    assert len(low) == windows and n < 1 << 24
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, place[first], h[place[first]].astype(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, windows, place of the anchor, hash) of all pieces; long texts go by blocks, each with its own windows."""
    for at in range(0, len(text) - length + 1, SCAN):
        block = np.frombuffer(text, np.uint8, min(SCAN + length - 1, len(text) - at), at)
        first, place, h = _anchors(block, length)
        count = np.diff(first, append=len(block) - length + 1)
        yield first + at, count, place + at, h


def _list_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, counts, offsets, hashes, digests = [], [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for first, count, place, h in _pieces(text, length):
                    keys += [key] * len(first)
                    starts.append(first)
                    counts.append(count)
                    offsets.append(place - first)
                    hashes.append(h)
                    digests += [_digest(text[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
            cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), cat(starts, pa.int64()), cat(counts, pa.int32()), cat(offsets, pa.int32()), cat(hashes, pa.int64()), pa.array(digests, pa.binary())], names=["doc", "start", "windows", "lead", "anchor", "digest"])

    return thrifty(run)


PIECE = "doc binary, start long, windows int, lead int, anchor long, digest binary"


def repeats_in(group: np.ndarray, lead: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces (as piece, place in the piece) that repeat within their group.

    Pieces are aligned so that their anchors stand in one column. Column c holds the byte c places right of
    the leftmost lead; the rounds go from the last column to the first.
    """
    m = len(texts)
    most = int(lead.max())
    wide = most + length
    grid = np.zeros((m, wide), np.uint8)
    have = np.zeros(m, np.int64)
    for i, t in enumerate(texts):
        a = most - int(lead[i])
        t = t[: wide - a]
        grid[i, a : a + len(t)] = np.frombuffer(t, np.uint8)
        have[i] = a + len(t)
    first = most - lead
    columns = np.ascontiguousarray(grid.T)
    del grid
    _, group = np.unique(group, return_inverse=True)
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(m, np.int32)  # common prefix of each suffix in the order with the one before
    own = group.astype(np.uint16) if group.max() < 1 << 16 else group
    with tempfile.TemporaryFile() as ranks, tempfile.TemporaryFile() as prefixes:
        kept: list[int] = []
        for c in range(wide - 1, -1, -1):
            # The collection's transform, in the order of the suffixes to the right; 0 where a piece has no byte here.
            symbol = np.where((have[order] > c) & (first[order] <= c), columns[c][order] + np.uint16(1), np.uint16(0))
            by_symbol = np.argsort(symbol, kind="stable")
            move = by_symbol[np.argsort(own[order][by_symbol], kind="stable")]
            prefix = _updated(prefix, move, symbol[move], group[order][move])
            order = order[move]
            if c < most + 1 and c + length <= wide:
                order.astype(np.int32).tofile(ranks)
                prefix.tofile(prefixes)
                kept.append(c)
        ranks.seek(0)
        prefixes.seek(0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for c in kept:
            at = np.frombuffer(ranks.read(4 * m), np.int32)
            near = np.frombuffer(prefixes.read(4 * m), np.int32) >= length
            hit = near.copy()
            hit[:-1] |= near[1:]
            i = at[hit]
            place = c - first[i]
            good = (place >= 0) & (place < windows[i])
            found.append((i[good], place[good]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _updated(prefix: np.ndarray, move: np.ndarray, symbol: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefixes in the new order: one more than the least between the two suffixes' places in the old order."""
    out = np.zeros(len(move), np.int32)
    same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & (group[1:] == group[:-1])) + 1
    if not len(same):
        return out
    a, b = move[same - 1] + 1, move[same] + 1  # the least of prefix[a:b]
    gap = b - a
    level = np.frexp(gap)[1] - 1
    least = np.empty(len(same), np.int32)
    table, width = prefix, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            least[at] = np.minimum(table[a[at]], table[b[at] - width])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    out[same] = least + 1
    return out


def _construct(length: int):
    """Rows sorted by anchor -> runs of repeated windows."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        anchor = np.array([r[0] for r in rows], np.int64)
        lead = np.array([r[3] for r in rows], np.int64)
        windows = np.array([r[4] for r in rows], np.int64)
        i, place = repeats_in(anchor, lead, windows, [r[5] for r in rows], length)
        order = np.lexsort((place, i))
        i, place = i[order], place[order]
        cut = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(place, prepend=-9) != 1))
        run = np.diff(cut, append=len(i))
        start = np.array([r[2] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in i[cut]], pa.binary()), pa.array(start[i[cut]] + place[cut]), pa.array(run)], names=["doc", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("anchor", "doc", "start", "lead", "windows", "piece")), strict=True):
                if size > COLLECTION and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += max(2 * length, 800)
                last = row[0]
        if held:
            yield solve(held)

    return thrifty(run)


RUN = "doc binary, start long, windows long"


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _stretches(length: int):
    """Pieces -> stretches of at most STRETCH windows, cut at fixed distances from the anchor.

    ``all`` digests the bytes of the stretch's windows together, ``core`` the bytes that every window of a whole
    stretch holds, ``lead`` counts from the first window to the place that the last one of a whole stretch has. Equal windows stand in
    stretches of equal places, and these have equal cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, start, windows, lead, anchor, piece in zip(*(b.column(n).to_pylist() for n in ("doc", "start", "windows", "lead", "anchor", "piece")), strict=True):
                place = 0
                while place < windows:
                    ahead = lead - place  # bytes from the window to the anchor
                    low = ahead // STRETCH * STRETCH  # the last window of the stretch is this far from it
                    n = min(ahead - low + 1, windows - place)
                    part = piece[place : place + n + length - 1]
                    core = piece[lead - low : max(lead - low, lead - low - STRETCH + 1 + length)]
                    rows.append((doc, start + place, n, ahead - low, _digest(part + b"%d" % low), _digest(core + b"%d %d" % (low, anchor)), part))
                    place += n
            yield pa.RecordBatch.from_pylist([dict(zip(STRETCH_SCHEMA.names, r, strict=True)) for r in rows], schema=STRETCH_SCHEMA)

    return run


STRETCH = 16
STRETCH_SCHEMA = pa.schema([("doc", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("lead", pa.int32()), ("all", pa.binary()), ("core", pa.binary()), ("piece", pa.binary())])
STRETCHES = "doc binary, start long, windows int, lead int, all binary, core binary, piece binary"


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, start, windows, piece in zip(*(b.column(n).to_pylist() for n in ("doc", "start", "windows", "piece")), strict=True):
                digests = [_digest(piece[k : k + length]) for k in range(windows)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * windows, pa.binary()), pa.array(range(start, start + windows), pa.int64()), pa.array(digests, pa.binary())], names=["doc", "start", "digest"])

    return run


def _hot_runs(hot: DataFrame, length: int) -> DataFrame:
    """Repeated runs among pieces of crowded anchors.

    What joins share is stored first, so that both sides are dealt anew and a partition that is large can be split.
    """
    stretches = stored(hot.mapInArrow(_stretches(length), STRETCHES), "stretches")
    kinds = stored(stretches.groupBy("core", "all").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("p")), "stretch-kinds")
    same = stretches.join(kinds.where("n > 1").select("all"), "all", "left_semi").select("doc", "start", F.col("windows").cast("long").alias("windows"))
    cores = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "stretch-cores")
    # One stretch stands for all with its bytes.
    ones = stored(kinds.join(cores, "core").select("core", "p.doc", "p.start", (F.col("kinds") > GROUP).alias("crowded")), "stretch-ones")
    bytes_of = stored(stretches.join(ones, ["doc", "start"]).select("crowded", F.xxhash64(stretches["core"]).alias("anchor"), "doc", "start", "lead", "windows", "piece"), "stretch-pieces")
    built = bytes_of.where("not crowded").drop("crowded").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_construct(length), RUN)
    windows = stored(bytes_of.where("crowded").select("doc", "start", "windows", "piece").mapInArrow(_window_digests(length), "doc binary, start long, digest binary"), "windows")
    again = stored(windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "equal-windows")
    found = windows.join(again, "digest", "left_semi").select("doc", "start", F.lit(1).cast("long").alias("windows"))
    return same.unionByName(built).unionByName(found)


def _cut_pieces(length: int):
    """Documents with the places of their pieces -> pieces with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, pieces in zip(*(b.column(n).to_pylist() for n in ("doc", "bytes", "pieces")), strict=True):
                rows = [(doc, p["start"], p["windows"], p["lead"], p["anchor"], p["hot"], text[p["start"] : p["start"] + p["windows"] + length - 1] if p["hot"] else text[p["start"] : p["start"] + p["lead"] + length]) for p in pieces]
                yield pa.RecordBatch.from_pylist([dict(zip(CUT_NAMES, r, strict=True)) for r in rows], schema=CUT_SCHEMA)

    return run


CUT_NAMES = ("doc", "start", "windows", "lead", "anchor", "hot", "piece")
CUT_SCHEMA = pa.schema([("doc", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("piece", pa.binary())])
CUT = "doc binary, start long, windows int, lead int, anchor long, hot boolean, piece binary"


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of windows that repeat, as (doc, start, windows); docs has ``doc`` (a key) and ``bytes``."""
    listed = stored(docs.mapInArrow(_list_pieces(length), PIECE), "pieces")
    # Stored, here and below, so that joins deal both sides anew and large partitions can be split.
    shared = stored(listed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    pieces = stored(listed.join(shared, "anchor", "left_semi"), "shared-pieces")
    drop_stored(listed, shared)
    kinds = stored(pieces.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "windows", "lead")).alias("p")), "piece-kinds")
    whole = pieces.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("doc", "start", F.col("windows").cast("long").alias("windows"))
    groups = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "piece-groups")
    # One piece stands for all with its bytes.
    ones = kinds.join(groups, "anchor").select("anchor", "p.*", (F.col("kinds") > GROUP).alias("hot"))
    wanted = ones.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "lead", "anchor", "hot")).alias("pieces"))
    cut = stored(docs.join(wanted, "doc").mapInArrow(_cut_pieces(length), CUT), "cut-pieces")
    built = cut.where("not hot").select("anchor", "doc", "start", "lead", "windows", "piece").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_construct(length), RUN)
    hot = cut.where("hot")
    runs = whole.unionByName(built)
    if not hot.isEmpty():
        runs = runs.unionByName(_hot_runs(hot.select("doc", "start", "windows", "lead", "anchor", "piece"), length))
    runs = stored(runs, "runs")
    drop_stored(pieces, kinds, groups, cut)
    return runs


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, spans = [], [], []
            for text, runs in zip(b.column("bytes").to_pylist(), b.column("runs").to_pylist(), strict=True):
                out, at, gone, count = [], 0, 0, 0
                for r in sorted(runs or [], key=lambda r: r["start"]):
                    stop = r["start"] + r["windows"] + length - 1
                    if count and r["start"] <= at:  # touches or overlaps the run before
                        gone += max(0, stop - at)
                        at = max(at, stop)
                        continue
                    out.append(text[at : r["start"]])
                    gone += stop - r["start"]
                    at, count = stop, count + 1
                out.append(text[at:])
                kept.append(b"".join(out))
                removed.append(gone)
                spans.append(count)
            names = [n for n in b.schema.names if n not in ("bytes", "runs")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*names, "kept", "n_removed", "n_spans"])

    return run


def whole_characters(df: DataFrame, kept: str = "kept", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the text of ``kept`` without the bytes that are no whole character."""
    keep = [f for f in df.schema.fields if f.name not in (kept, out)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.decode("utf-8", "ignore") for x in b.column(kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` string"]))


#: Columns that ``remove_repeats`` adds; an input column of such a name gives way to them.
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")


def _cut(df: DataFrame, length: int, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """Columns c0, c1, ... for those of ``keep``, so that their names clash with nothing, and RESULTS."""
    passed = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    keyed = df.select(*passed, row_key(doc_id, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    runs = repeated_runs(keyed.select("doc", "bytes"), length)
    # Pieces of equal rows bear one key, and their runs are equal: one of each will do.
    by_doc = runs.groupBy("doc").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    joined = keyed.join(by_doc, "doc", "left").select(*[f"c{i}" for i in range(len(keep))], F.octet_length("bytes").cast("long").alias("n_bytes"), "bytes", "runs")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("bytes", "runs")), "kept binary, n_removed long, n_spans long"])
    return joined.mapInArrow(_remove(length), ddl)


def remove_repeats(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with kept (binary), n_bytes, n_removed and n_spans; of input columns of these names, the new ones are given.

    A removed run may begin or end within a character; ``whole_characters`` makes a text of what is kept.
    """
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in RESULTS]
    return _cut(df, length, doc_id, text, list(keep)).select(*named, *RESULTS)


def without_repeats(df: DataFrame, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without their repeated passages, all columns under their own names; rows of which nothing is left go.

    A column ``n_chars`` follows the text where that has changed. Rows without text stay as they are, repeated rows stay repeated
    (what is left of them, if anything), and columns may have any names.
    """
    rest = [c for c in df.columns if c != text]
    left = whole_characters(_cut(df, length, doc_id, text, rest).where("n_removed = 0 or n_removed < n_bytes"), out="text")
    fresh = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(rest)} | {text: F.col("text").alias(text)}
    if "n_chars" in rest:
        fresh["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"c{rest.index('n_chars')}")).alias("n_chars")
    return left.select(*[fresh[c] for c in df.columns])
