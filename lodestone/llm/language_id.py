"""Languages of texts by multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all documents of the training part. The model is fitted on a bounded sample by
follow-the-regularised-leader with elastic-net penalties; a fifth of the sample, which the fit doesn't see, gives the
temperature that divides the scores. Every text is read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_table, prepare, stored, thrifty

#: Places of hashed n-grams, and the lengths of these.
BITS, ORDERS = 16, (1, 2, 3)
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 19
#: Documents that the fit and the calibration see in all, dealt evenly to the languages; each has one at least.
SAMPLE = 4000
#: Learning rate and its offset, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.02, 0.05, 4
FOLDS = 5
UNKNOWN = "und"

Row = tuple[int, np.ndarray, np.ndarray]


def counts(text: str) -> np.ndarray:
    """How often each place occurs among the n-grams of the lower-cased text, with a space before and behind."""
    out = np.zeros(1 << BITS, np.int64)
    longest = max(ORDERS)
    text = f" {text.lower()} "
    for start in range(0, len(text), BLOCK):
        # Behind the block stands what its last n-grams need of the next one.
        codes = np.frombuffer(text[start : start + BLOCK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        held, found = np.zeros(len(codes), np.uint64), []
        for n in range(1, longest + 1):
            upto = len(codes) - n + 1
            if upto <= 0:
                break
            held = (held[:upto] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            if n in ORDERS:
                found.append(held[:BLOCK] >> np.uint64(64 - BITS))
            held = held ^ (held >> np.uint64(29))
        out += np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    return out


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: 1 + ln(count) times idf, to a length of 1 in all."""
    n = counts(text)
    at = np.flatnonzero(n)
    values = (1 + np.log(n[at])) * idf[at]
    return at, values / np.sqrt(values @ values)


def fit(rows: list[Row], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (place, class) and biases. Rows (class, places, values) are taken one after the other, in an order that differs by pass.

    The rate of a weight falls with the gradients that it has seen; weights whose sum stays below the L1 penalty are
    exactly 0, the L2 penalty shrinks the others. The bias is the last place and has no penalty.
    """
    d = 1 << BITS
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    l1, l2 = np.full((d + 1, 1), L1), np.full((d + 1, 1), L2)
    l1[d] = l2[d] = 0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0) / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at])

    for turn in range(PASSES):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            own, at, values = rows[i]
            at, values = np.append(at, d), np.append(values, 1.0)
            w = weights(at)
            p = _chances(values @ w)
            p[own] -= 1
            g = values[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(slice(None))
    return every[:d], every[d]


def _chances(logits: np.ndarray) -> np.ndarray:
    x = np.exp(logits - logits.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, own: np.ndarray) -> float:
    """What to divide logits (row, class) by for the rows' own classes to be likeliest, by narrowing a bracket of its logarithm.

    One row's worth of doubt is spread over the other classes, or classes without an error would call for no heat at all.
    """
    if not len(own) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(own) + 2)
    wanted = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    wanted[np.arange(len(own)), own] = 1 - doubt

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        top = x.max(1)
        return float((top + np.log(np.exp(x - top[:, None]).sum(1)) - (wanted * x).sum(1)).mean())

    low, high, part = np.log(0.01), np.log(100.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fold(doc_id: Column) -> Column:
    """The id's CRC modulo FOLDS; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the number of texts (place -1), and one for each place with the number of texts that have it."""
    seen, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen[np.flatnonzero(counts(text.as_py()))] += 1
        rows += batch.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(seen[at], rows))})


def _sampled(known: DataFrame, sizes: DataFrame, each: int) -> DataFrame:
    """lang, text, nth: ``each`` rows of a language or all it has, those of the smallest hashes."""
    hashed = join_table(known, sizes, ["lang"], F.xxhash64("doc_id")).withColumn("_at", F.xxhash64("doc_id", F.length("text")))
    # First a share of about twice as many, so that only their texts are sorted; rows of equal hashes are cut by the window.
    share = F.shiftrightunsigned("_at", 1).cast("double") / 2.0**63
    near = hashed.where(share * F.col("n") <= 2 * each + 50)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_at", "doc_id", "text"))
    return near.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text", "nth")


class Model:
    """Languages and what tells them apart: idf by place, weights by place and language, biases, temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float) -> None:
        self.languages, self.idf, self.weights, self.bias, self.heat = languages, idf, weights, bias, heat

    def best(self, text: str) -> tuple[str, float]:
        at, values = features(text, self.idf)
        p = _chances((values @ self.weights[at] + self.bias) / self.heat)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def train(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the rows of ``documents`` (doc_id, text, lang) outside fold 0 that have a text and a language; None without such rows."""
    prepare(documents.sparkSession)
    known = documents.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    languages = sorted(r.lang for r in sizes.collect())  # the classes of the model
    if not languages:
        return None
    seen = known.select("text").mapInArrow(thrifty(_count_documents), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = {r.place: r.n for r in seen.collect()}  # as many rows as places
    df = np.array([n.get(i, 0) for i in range(1 << BITS)])
    idf = np.log((1 + n[-1]) / (1 + df)) + 1

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r.nth, r.lang, *features(r.text, idf)) for part in batches for r in part.itertuples())
        rows = [(nth, languages.index(lang), at, values) for nth, lang, at, values in rows]
        # A language's first rows are always fitted.
        weights, bias = fit([r[1:] for r in rows if r[0] % 5], len(languages))
        apart = [r[1:] for r in rows if r[0] % 5 == 0]
        logits = np.array([values @ weights[at] + bias for _, at, values in apart])
        heat = temperature(logits, np.array([own for own, _, _ in apart]))
        used = np.flatnonzero(weights.any(1))
        yield pd.DataFrame({"place": np.append(used, [-1, -2]), "weights": [*weights[used], bias, np.array([heat])]})

    # One task, as the rows follow one another; their number is bounded.
    fitted = _sampled(known, sizes, max(1, sample // len(languages))).coalesce(1).mapInPandas(thrifty(learn), "place int, weights array<double>")
    rows = {r.place: r.weights for r in fitted.collect()}  # at most a row for each place, and two
    weights = np.zeros((1 << BITS, len(languages)))
    for place, w in rows.items():
        if place >= 0:
            weights[place] = w
    return Model(languages, idf, weights, np.array(rows[-1]), rows[-2][0])


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``documents`` (doc_id, text, lang).

    A row is held out if its id's CRC is divisible by 5; the others with text and language are learned from. A prediction depends on the text
    alone. Null texts and those without a letter are ``und`` with score 0, and so are all if there is nothing to
    learn from. Repeated rows have equal results; a null id counts as an empty one; equal scores go to the
    language that comes first. Other columns are ignored, whatever their names.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang")
    model = train(rows, sample)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.when(letters, F.col("text")).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.best(t.as_py()) if model and t.is_valid else (UNKNOWN, 0.0) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(thrifty(predict), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
