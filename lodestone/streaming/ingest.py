"""Ingest as a stateful stream: what a source's deliveries and withdrawals do to its state, one at a time.

Input: source, arrival, kind (push, pull, withdraw), digest, sequence, gap_start, gap_stop, expected, next, resume, withdrawal.
Output: source, arrival, verdict, high. A delivery that was accepted before with the same digest is a no-op, checked first. A pull is taken
only if it expects the checkpoint that the last one left (compare and swap). Receipts are state of their own, keyed by arrival, of which a delivery
reads and writes its own only.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUTPUT = "source long, arrival long, verdict string, high long"
STATE = "high long, checkpoint string, withdrawal string"
#: What the stream's session needs, as receipts are state with keys of their own.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
INPUT = ["source", "arrival", "kind", "digest", "sequence", "gap_start", "gap_stop", "expected", "next", "resume", "withdrawal"]


@dataclass
class Source:
    high: int | None = None
    checkpoint: str | None = None
    withdrawal: str | None = None


def advance(s: Source, e: dict, receipts: MutableMapping[int, str]) -> str:
    """The verdict on one event; accepted ones change the state. ``receipts``: digests of accepted deliveries by arrival."""
    if e["kind"] == "withdraw":
        if s.withdrawal is not None:
            return "same" if s.withdrawal == e["withdrawal"] else "conflict"
        s.withdrawal = e["withdrawal"]
        return "withdrawn"
    known = receipts.get(e["arrival"])
    if known is not None:
        return "replay" if known == e["digest"] else "conflict"
    if e["resume"] != s.withdrawal:  # an active source takes no resume, a withdrawn one only its own
        return "conflict" if s.withdrawal is None else "withdrawn_source"
    if e["kind"] == "pull":
        if e["expected"] != s.checkpoint:
            return "conflict"
        verdict = "pulled"
    else:
        verdict = _push(s.high, e["sequence"], e["gap_start"], e["gap_stop"])
        if verdict == "invalid":
            return verdict
    if e["kind"] == "pull":
        s.checkpoint = e["next"]
    elif verdict in ("first", "next", "jump"):
        s.high = e["sequence"]
    s.withdrawal = None
    receipts[e["arrival"]] = e["digest"] or ""
    return verdict


def _push(high: int | None, n: int | None, gap_start: int | None, gap_stop: int | None) -> str:
    jump = n is not None and high is not None and n > high + 1
    if jump:
        return "jump" if (gap_start, gap_stop) == (high + 1, n) else "invalid"
    if gap_start is not None or gap_stop is not None:
        return "invalid"
    if n is None:
        return "unnumbered"
    return "first" if high is None else "late" if n <= high else "next"


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
        yield {k: int(v) if isinstance(v, float) and k in ("sequence", "gap_start", "gap_stop") else v for k, v in row.items()}


def _told(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["source", "arrival", "verdict", "high"])
    frame["high"] = frame["high"].astype("Int64")
    return frame


class _Receipts(MutableMapping):
    """A source's receipts in the state store."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, arrival: int) -> str:
        if not self.state.containsKey((arrival,)):
            raise KeyError(arrival)
        return self.state.getValue((arrival,))[0]

    def __setitem__(self, arrival: int, digest: str) -> None:
        self.state.updateValue((arrival,), (digest,))

    def __delitem__(self, arrival: int) -> None:
        self.state.removeKey((arrival,))

    def __iter__(self) -> Iterator[int]:
        return (k[0] for k in self.state.keys())  # noqa: SIM118

    def __len__(self) -> int:
        return sum(1 for _ in self)


class Ingest(StatefulProcessor):
    """State by source: where it stands, and a receipt for each accepted delivery."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stands = handle.getValueState("stands", STATE)
        self.receipts = handle.getMapState("receipts", "arrival long", "digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        source = Source(*self.stands.get()) if self.stands.exists() else Source()
        receipts, out = _Receipts(self.receipts), []
        # The events of one source in one micro-batch.
        for e in sorted((e for frame in rows for e in _records(frame)), key=lambda e: e["arrival"]):
            verdict = advance(source, e, receipts)
            out.append((key[0], e["arrival"], verdict, source.high))
        self.stands.update(astuple(source))
        yield _told(out)

    def close(self) -> None:
        pass


def verdicts(events: DataFrame) -> DataFrame:
    """A stream of events to a stream of verdicts, for a session with STATE_STORE. A query that restarts from its checkpoint goes on where it stood."""
    return events.select(*INPUT).groupBy("source").transformWithStateInPandas(Ingest(), OUTPUT, "Append", "None")


def verdicts_in_batch(events: DataFrame) -> DataFrame:
    """The same fold over a whole table: sources one after the other, events as they come, receipts of one source at a time."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, source, receipts = None, Source(), {}
        for frame in frames:
            out = []
            for e in _records(frame):
                if at is None or e["source"] != at:
                    at, source, receipts = e["source"], Source(), {}
                verdict = advance(source, e, receipts)
                out.append((at, e["arrival"], verdict, source.high))
            yield _told(out)

    return events.select(*INPUT).repartition("source").sortWithinPartitions("source", "arrival").mapInPandas(fold, OUTPUT)


def events_of(table: DataFrame) -> DataFrame:
    """Ingest events made from a table of user events: every user is a source.

    Pushes are numbered on end, with a declared gap at every sixth; others are planted among them: undeclared gaps, late and
    unnumbered ones, deliveries that come twice, pulls that expect another checkpoint, withdrawals, and deliveries to a withdrawn source with and
    without its resumption.
    """
    n, text = F.col("event_id"), lambda c: c.cast("string")
    by = Window.partitionBy("user_id").orderBy("event_id")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    alone = (F.coalesce(F.lag("event_id", 1).over(by) % 29, F.lit(1)) != 0) & (F.coalesce(F.lag("event_id", 2).over(by) % 29, F.lit(1)) != 0)
    kind = F.when((n % 29 == 0) & alone, "withdraw").when(n % 4 == 0, "pull").otherwise("push")
    rows = table.select("user_id", "event_id", kind.alias("kind"), F.sha2(F.coalesce("props", F.lit("")).cast("binary"), 256).alias("digest"))
    # Right after a withdrawal a delivery resumes it, or, for some, the one after that.
    rows = rows.withColumn("_down", F.coalesce(F.lag("kind", 1).over(by) == "withdraw", F.lit(False)) & (n % 3 == 0) & (F.col("kind") != "withdraw"))
    before, earlier = F.lag("kind", 1).over(by) == "withdraw", F.lag("kind", 2).over(by) == "withdraw"
    resume = F.when(before & ~F.col("_down"), text(F.lag("event_id", 1).over(by))).when(earlier & F.lag("_down", 1).over(by), text(F.lag("event_id", 2).over(by)))
    rows = rows.withColumn("resume", F.when(F.col("kind") != "withdraw", resume))
    push = (F.col("kind") == "push") & ~F.col("_down")
    k = F.sum(push.cast("long")).over(upto)
    rows = rows.withColumn("_type", F.when(~push, None).when((k % 11 == 0) & F.col("resume").isNull(), "invalid").when(k % 13 == 0, "late").when(k % 17 == 0, "unnumbered").otherwise("next"))
    rows = rows.withColumn("_m", F.sum((F.coalesce(F.col("_type") == "next", F.lit(False))).cast("long")).over(upto))
    top = lambda m: m + 2 * F.floor(m / 6)
    at = top(F.col("_m"))
    jump = (F.col("_type") == "next") & (F.col("_m") % 6 == 0)
    sequence = F.when(F.col("_type") == "next", at).when(F.col("_type") == "invalid", at + 5).when(F.col("_type") == "late", F.greatest(F.lit(1), at - 4)).when(F.col("kind") == "push", F.when(F.col("_down"), at + 1))
    pull = (F.col("kind") == "pull") & ~F.col("_down")
    wrong = (n % 5 == 0) & F.col("resume").isNull()
    rows = rows.withColumn("_good", pull & ~wrong)
    left = F.last(F.when(F.col("_good"), text(n)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    events = rows.select(
        F.col("user_id").alias("source"), n.alias("arrival"), "kind", "digest",
        sequence.cast("long").alias("sequence"),
        F.when(jump, top(F.col("_m") - 1) + 1).cast("long").alias("gap_start"), F.when(jump, at).cast("long").alias("gap_stop"),
        F.when(F.col("kind") == "pull", F.when(wrong, F.lit("another")).otherwise(left)).alias("expected"),
        text(n).alias("next"), "resume", text(n).alias("withdrawal"),
        F.when((F.col("_type") == "next") & (n % 19 == 0) & F.col("resume").isNull(), 2).otherwise(1).alias("_times"),
    )
    return events.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*INPUT)


def verdicts_of_table(spark: SparkSession, table: DataFrame) -> DataFrame:
    return verdicts_in_batch(events_of(table))
