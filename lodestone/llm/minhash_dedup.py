"""Near-duplicate documents by bottom-k sketches of one hash function.

Each document's set of word shingles is hashed once by one function. Documents with equal sets form
a class that goes on as one row, under a dense number. The k smallest hashes of a class (its sketch) are its
retained values; inverted lists of retained values generate overlaps between classes; the sketch of a pair's union estimates
the similarity and drops what is far below the threshold; the exact Jaccard
similarity of full sets decides on what remains. Components of the links are returned.

What is listed. A similar pair shares at least ``o`` retained values: sets of few shingles are
retained whole, and for larger ones fewer than o shared values have a
probability below e^-18 (Chernoff). So, in any one order of the values, the first
|sketch| - o + OVERLAP of both share OVERLAP of them (or all of their shared values, if fewer). The order puts values from crowded cells of a count
table of fixed size last, so common lines and passages rarely make it into the lists. Where they
do, because most of a document is common, the document retains its whole set for listing: there the
first n - ceil(threshold * n) + OVERLAP values are enough, and crowded values of the sketch aren't listed.
Two such documents share OVERLAP of the former, any other pair as many uncrowded ones of the latter.

What is compared. Pairs that share fewer listed values than that are no candidates, which leaves few
pairs of texts that only have common phrases. Sketches and sets are made again, from the texts, of candidates only,
so neither moves for all documents. A first round compares each member of a list with one central member, and joins what is
linked. A second round compares, where a list still holds several components, members of
different components. Short lists give pairs of members; longer ones, and clusters of them that overlap, are cut into
blocks, and two blocks are a unit of work; a unit counts the shared values of its pairs at once and gives out a forest of links, so no pairs of long lists are
made as rows and no task holds such a list. A pair that shares a long list meets in a unit; any other shares only short ones, so its overlap is counted whole. Members of one component need no further comparison:
links are lost only inside components.

Edge cases: null, empty or blank texts have no shingles and link with nothing. Texts of fewer words than a shingle
have one, the whole sequence. Texts of any length are taken whole. Rows with equal ids are rows of their own; their class is
by set, so they share a component anyway. A null id is never the smallest while there is
another; a component of null ids only has a null component and is kept. Extra columns, whatever their names, are not read.
An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_key, stored, thrifty
from .common import rest as collect_garbage
from .graph import components
from .rolling import mix, slice_hashes

K = 128
#: Listed values that a candidate pair shares.
OVERLAP = 3
#: Cells of the table of value counts, and how many of them move as one row.
CELLS, SEGMENT = 1 << 20, 1 << 14
#: Members of a list that one task compares with as many others.
BLOCK_MEMBERS = 512
#: Members of a list whose pairs may be made as rows: a bound on rows for each member.
SHORT = 32
#: The union-sketch estimate may fall short of the threshold by so many standard deviations.
SLACK = 6.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_FACTORS = tuple(np.uint64(pow(0xA0761D6478BD642F, i + 1, 1 << 64) | 1) for i in range(64))


def shared_at_least(threshold: float, k: int = K) -> int:
    """Retained values that a pair at the threshold shares but for a probability of e^-18."""

    def exponent(o: int) -> float:
        q = o / k
        return k * (q * math.log(q / threshold) + (1 - q) * math.log((1 - q) / (1 - threshold))) if 0 < q < threshold else 0.0

    return max((o for o in range(1, k) if exponent(o) >= 18), default=1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, on end; and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blank = _BLANK[data]
    edge = np.diff(blank.view(np.int8), prepend=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = slice_hashes(_LOWER[data], starts, stops)
    owner = np.repeat(np.arange(len(texts)), sizes)[starts]
    n_words = np.bincount(owner, minlength=len(texts))
    n = len(words)
    full = np.zeros(max(n - width + 1, 0), np.uint64)
    for i in range(width if n >= width else 0):
        full += words[i : n - width + 1 + i] * _FACTORS[i % 64]
    inside = owner[: len(full)] == owner[width - 1 :] if n >= width else np.zeros(0, bool)
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    first = np.cumsum(n_words) - n_words
    short = [sum((int(w) * int(_FACTORS[i % 64]) for i, w in enumerate(words[first[d] : first[d] + n_words[d]])), int(n_words[d])) & (2**64 - 1) for d in few]
    value = mix(np.concatenate([full[inside], np.array(short, np.uint64)]))
    of = np.concatenate([owner[: len(full)][inside], few])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.bincount(of, minlength=len(texts))


def _batches(texts: list[str | None], limit: int = 1_000_000) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in texts:
        x = (x or "").encode()
        if held and size + len(x) > limit:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def _marks(value: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The class of each set: two independent sums over it, which don't depend on an order."""
    sums = []
    for f in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(f)))])
        sums.append(mix(total[starts + counts] - total[starts] + counts.astype(np.uint64)))
    both = np.stack(sums, 1).astype(">u8").view(np.uint8).reshape(-1, 16)
    return pa.array([m.tobytes() for m in both], pa.binary())


def _signed(value: np.ndarray) -> np.ndarray:
    """As signed words in the same order."""
    return (value ^ np.uint64(1 << 63)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(_signed(np.concatenate(arrays)) if arrays else [], pa.int64()))


SUMMARY = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("segment", pa.int32()), ("counts", pa.binary())])


def _summaries(width: int):
    """Rows of documents, and behind a partition's last one rows (segment, counts) of all its shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            at = 0
            for texts in _batches(b.column("text").to_pylist()):
                value, counts = shingle_sets(texts, width)
                hit, n_hit = np.unique((value & np.uint64(CELLS - 1)).astype(np.int32), return_counts=True)
                cells[hit] += n_hit.astype(np.uint32)
                part, n = b.slice(at, len(texts)), len(texts)
                at += n
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), part.column("key"), pa.array(counts, pa.int64()), _marks(value, np.cumsum(counts) - counts, counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=SUMMARY)
        segments = [k for k in range(CELLS // SEGMENT) if cells[k * SEGMENT : (k + 1) * SEGMENT].any()]
        packed = [pa.compress(cells[k * SEGMENT : (k + 1) * SEGMENT].tobytes(), codec="zstd", asbytes=True) for k in segments]
        n = len(segments)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())], pa.array(segments, pa.int32()), pa.array(packed, pa.binary())], schema=SUMMARY)

    return thrifty(run)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, counts) -> their sums, one row for each segment of a partition; counts of a cell end at 2**32 - 1."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, packed in zip(b.column("segment").to_pylist(), b.column("counts").to_pylist(), strict=True):
            here = np.frombuffer(pa.decompress(packed, decompressed_size=4 * SEGMENT, codec="zstd", asbytes=True), np.uint32)
            total[k] = np.minimum(total.get(k, 0) + here.astype(np.int64), 2**32 - 1)
    for k, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(counts.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["segment", "counts"])


def _crowd(made: DataFrame) -> np.ndarray:
    """The count table: a fixed number of cells, whatever the input. Tasks add up what they hold before it moves."""
    out = np.zeros(CELLS, np.int64)
    sums = made.where("segment is not null").select("segment", "counts")
    for deal in (lambda x: x, lambda x: x.repartition("segment")):
        sums = deal(sums).mapInArrow(_added, "segment int, counts binary")
    for r in sums.toArrow().to_pylist():
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(pa.decompress(r["counts"], decompressed_size=4 * SEGMENT, codec="zstd", asbytes=True), np.uint32)
    return out


def _rarest(value: np.ndarray, crowd: np.ndarray, n: int) -> np.ndarray:
    return value[np.lexsort((value, crowd[(value & np.uint64(CELLS - 1)).astype(np.int64)]))][:n]


def to_list(value: np.ndarray, crowd: np.ndarray, bound: float, threshold: float, k: int = K, overlap: int = OVERLAP) -> np.ndarray:
    """Values of a set (ascending) under which it goes into the lists."""
    n, sketch = len(value), value[:k]
    exact = max(math.ceil(n * threshold - 1e-9), 1)
    if n <= int(k * threshold):  # all that may be similar are retained whole
        return _rarest(sketch, crowd, n - exact + overlap)
    first = _rarest(sketch, crowd, len(sketch) - shared_at_least(threshold, k) + overlap)
    crowded = crowd[(first & np.uint64(CELLS - 1)).astype(np.int64)] > bound
    if not crowded.any():
        return first
    return np.union1d(first[~crowded], _rarest(value, crowd, n - exact + overlap))


def _listed(width: int, crowd: bytes, bound: float, threshold: float):
    """text -> n, class, listed, of texts with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(crowd, np.uint32)
        for b in batches:
            for texts in _batches(b.column("text").to_pylist()):
                value, counts = shingle_sets(texts, width)
                starts = np.cumsum(counts) - counts
                some = np.flatnonzero(counts)
                listed = [to_list(value[s : s + c], table, bound, threshold) for s, c in zip(starts[some], counts[some], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(counts[some], pa.int64()), _marks(value, starts[some], counts[some]), _lists(listed)], names=["n", "class", "listed"])

    return thrifty(run)


def _sets(width: int, wanted: bytes, most: int | None):
    """(key, text) -> class, values (the ``most`` smallest, or the whole set), of rows whose key's place in the bitmap is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
        for b in batches:
            b = b.filter(pa.array(bits[b.column("key").to_numpy() & (BITMAP - 1)].astype(bool)))
            for texts in _batches(b.column("text").to_pylist()):
                value, counts = shingle_sets(texts, width)
                starts = np.cumsum(counts) - counts
                taken = counts if most is None else np.minimum(counts, most)
                yield pa.RecordBatch.from_arrays([_marks(value, starts, counts), _lists([value[s : s + c] for s, c in zip(starts, taken, strict=True)])], names=["class", "values"])

    return thrifty(run)


def _values(needed: DataFrame, texts: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """node, values of ``needed`` (node, key, class), made again from their texts.

    A bitmap of fixed size tells most texts that nobody needs before anything moves.
    """
    places = needed.select(F.col("key").bitwiseAND(BITMAP - 1).cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()
    bits = np.zeros(BITMAP, bool)
    bits[places] = True
    again = texts.mapInArrow(_sets(width, np.packbits(bits).tobytes(), most), "class binary, values array<long>")
    # Another row's key may have the same place; the class tells them apart.
    return again.join(needed.select("class", "node"), "class").groupBy("node").agg(F.first("values").alias("values"))


def _units(percent: int):
    """Rows of whole units, a unit's on end -> a forest (a, b) of the links between components.

    Shared values are counted for all pairs of a unit at once: a product of the matrix of members and of the values that
    several of them have.
    """

    def solve(rows: pa.Table) -> tuple[list[int], list[int]]:
        rows = rows.combine_chunks().to_batches()[0]
        node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        side, same = rows.column("side").to_numpy(), bool(rows.column("same")[0].as_py())
        lists = rows.column("values")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(node)), sizes)
        several = count[at] > 1
        at, owner = at[several], owner[several]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        column = np.cumsum(np.diff(at, prepend=-1) != 0) - 1
        # Members of the largest component meet only others.
        _, which, members = np.unique(component, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(which != members.argmax())
        both = np.zeros((len(rest), len(node)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            here = (column >= first) & (column < first + 4096)
            matrix = np.zeros((len(node), min(4096, int(column[-1]) + 1 - first)), np.float32)
            matrix[owner[here], column[here] - first] = 1
            both += matrix[rest] @ matrix.T
        union = sizes[rest, None] + sizes[None, :] - both
        linked = (100 * both >= percent * union) & (component[rest, None] != component[None, :]) & (union > 0)
        if not same:
            linked &= side[rest, None] != side[None, :]
        x, y = np.nonzero(linked)
        x = rest[x]
        parent = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        out: tuple[list[int], list[int]] = ([], [])
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if (a := root(int(component[i]))) != (b := root(int(component[j]))):
                parent[max(a, b)] = min(a, b)
                out[0].append(int(node[i]))
                out[1].append(int(node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            a, b = solve(pa.Table.from_batches(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            unit = b.column("unit").to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(unit)], strict=True):
                if held and unit[s] != last:
                    yield done()
                if e > s:
                    held.append(b.slice(s, e - s))
                    last = unit[s]
        if held:
            yield done()

    return run


BITMAP = 1 << 22


def _close(threshold: float, k: int = K):
    """Pairs whose union sketch shares enough: (a, b, va, vb) -> (a, b)."""
    low = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("va"), batch.column("vb"), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                union = np.union1d(a, b)[:k]
                both = np.intersect1d(a, b, assume_unique=True)
                good.append(int((both <= union[-1]).sum()) >= low * len(union))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("va"), batch.column("vb"), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _with(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs with the values of both ends."""
    one = pairs.join(values.select(F.col("node").alias("a"), F.col("values").alias("va")), "a")
    return one.join(values.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b").select("a", "b", "va", "vb")


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that are similar. nodes: node, n, key, class; texts: key and text of all rows."""

    def ends(of: DataFrame) -> DataFrame:
        both = of.select(F.col("a").alias("node")).unionByName(of.select(F.col("b").alias("node"))).distinct()
        return stored(nodes.join(both, "node", "left_semi").select("node", "n", "key", "class"), "ends")

    asked = ends(pairs)
    sketches = stored(_values(asked, texts, width, K).join(asked.select("node", "n"), "node"), "sketches")
    close = stored(_with(pairs, sketches).mapInArrow(_close(percent / 100), "a long, b long"), "close-pairs")
    # Small sets are in the sketch whole; only larger ones are made again.
    large = ends(close).where(F.col("n") > K)
    whole = sketches.where(F.col("n") <= K).select("node", "values").unionByName(_values(large, texts, width))
    out = stored(_with(close, whole).mapInArrow(_exact(percent), "a long, b long"), "links")
    drop_stored(asked, sketches, close)
    collect_garbage(pairs.sparkSession)
    return out


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links need 100 * intersection >= percent * union.

    Also mark (128 bits of id and text) and component (null without shingles), for telling rows of equal ids apart.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("mark"), F.col(text).alias("text")).withColumn("key", F.xxhash64("mark"))
    summary = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in SUMMARY)
    made = stored(rows.mapInArrow(_summaries(width), summary), "documents")
    docs = made.where("segment is null").select("doc_id", "mark", "key", "n_shingles", "class")
    # Classes go by dense numbers from here on, which are exact and small; the table is stored, so they stay what they are.
    nodes = docs.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    crowd = _crowd(made)
    # What stands out of the chance neighbours in a cell.
    bound = float(crowd.mean() + max(64.0, 8 * math.sqrt(crowd.mean())))
    threshold = percent / 100
    given = rows.select("text").mapInArrow(_listed(width, crowd.astype(np.uint32).tobytes(), bound, threshold), "n long, class binary, listed array<long>")
    given = given.groupBy("class").agg(F.first("listed").alias("listed")).join(nodes.select("class", "node", "n"), "class")
    posted = stored(given.select(F.explode("listed").alias("value"), "node", "n"), "posted")
    several = posted.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    plain = stored(posted.join(several, "value"), "lists")
    drop_stored(posted)
    # The pivot of a list is the member whose lists are the longest together: in a group of copies the one least changed.
    weight = plain.groupBy("node").agg(F.sum("members").alias("weight"))
    heavy = plain.join(weight, "node").groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    lists = stored(plain.select("value", "node", "n").join(heavy.select("value", F.col("top.node").alias("pivot"), F.col("top.n").alias("m")), "value"), "pivoted-lists")
    drop_stored(plain)
    collect_garbage(df.sparkSession)
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    enough = f"overlap >= least({OVERLAP}, ({percent} * greatest(n, m) + 99) div 100)"

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs met in lists (a, b, n, m), each once, if they share enough listed values."""
        ordered = met.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("n", "m").alias("n"))
        return ordered.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first("n").alias("n"), F.first("n").alias("m")).where(enough).select("a", "b")

    stars = stored(candidates(lists.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n", "m")), "stars")
    texts = rows.select("key", "text")
    first = _links(stars, nodes, texts, width, percent)
    joined = components(first)
    rest = lists.join(joined, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = rest.groupBy("value").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first")).where("low <> high")
    rest = stored(rest.join(mixed.select("value", "members", "first"), "value"), "mixed-lists")
    drop_stored(lists)
    # Short lists give pairs.
    short = rest.where(F.col("members") <= SHORT)
    right = short.select("value", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("to"))
    cross = candidates(short.join(right, "value").where((F.col("node") < F.col("b")) & (F.col("component") != F.col("to"))).select(F.col("node").alias("a"), "b", "n", "m"))
    tried = stored(cross.join(stars, ["a", "b"], "left_anti"), "cross-pairs")
    second = _links(tried, nodes, texts, width, percent)
    third = _long_lists(rest.where(F.col("members") > SHORT), nodes, texts, width, percent)
    of = components(first.unionByName(second).unionByName(third))
    # A component is named by its smallest document, not by its smallest node.
    named = nodes.join(of, "node", "left").select("class", "least", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("class", "component", "component_id")
    out = docs.join(named, "class", "left")
    out = out.select("doc_id", "mark", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _long_lists(rest: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components of long lists (value, node, n, component, members, first)."""
    # Lists that overlap form clusters. A cluster is compared list by list or as a whole, whichever moves fewer rows.
    cluster = components(rest.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    inside = rest.join(cluster.select("node", F.col("component").alias("cluster")), "node")
    of_list = F.ceil(F.col("members") / BLOCK_MEMBERS)
    by_list = inside.groupBy("cluster").agg(F.sum(of_list).alias("list_rows"))
    nodes_in = inside.select("cluster", "node", "n", "component").distinct()
    sizes = by_list.join(nodes_in.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    sizes = stored(sizes.withColumn("whole", F.col("size") * F.ceil(F.col("size") / BLOCK_MEMBERS) <= F.col("list_rows")).select("cluster", "size", "whole"), "clusters")
    one = nodes_in.join(sizes.where("whole"), "cluster").select("node", "component", F.struct(F.lit(True).alias("w"), F.col("cluster").alias("k")).alias("group"), F.col("size").alias("members"))
    many = inside.join(sizes.where("not whole").select("cluster"), "cluster", "left_semi").select("node", "component", F.struct(F.lit(False).alias("w"), F.col("value").alias("k")).alias("group"), "members")
    placed = one.unionByName(many).withColumn("blocks", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "node", "component", F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.col("block").alias("side"), (F.col("block") == F.col("other")).alias("same")
    )
    needed = stored(nodes.join(rest.select("node").distinct(), "node", "left_semi").select("node", "key", "class"), "mixed-classes")
    ready = units.join(_values(needed, texts, width), "node").repartition("unit").sortWithinPartitions("unit")
    return stored(ready.mapInArrow(_units(percent), "a long, b long"), "unit-links")


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df``: all without shingles, and of each component one with the smallest id. Rows equal in id and text are one."""
    keyed = df.select(F.struct(*df.columns).alias("row"), row_key(doc_id, text).alias("mark"))
    judged = near_duplicates(df, width, percent, doc_id, text)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = judged.where("component is not null").groupBy("component").agg(F.min(rank).alias("best")).select("best.mark")
    stay = best.unionByName(judged.where("component is null").select("mark")).distinct()
    return keyed.join(stay, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*")
