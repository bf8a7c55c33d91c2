"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Bytes of an Arrow batch that goes to a worker, so that rows of long texts don't make it large.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds Arrow batches by bytes where the session states no bound of its own."""
    ship_package(spark)
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def rest(spark: SparkSession) -> None:
    """Has the driver and executors collect garbage, as buffers outside the heap are freed and the heap shrinks only then.

    Some small tasks for each core, so that nearly all executors get one; nothing depends on it.
    """
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
    tasks = 4 * spark.sparkContext.defaultParallelism
    collects = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).where(collects.isNull()).count()


def release() -> None:
    """Hands memory that a worker has no use for back to the system, as workers are used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, with ``release`` when its partition ends."""

    @wraps(run)
    def call(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return call


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (tests,
    a single machine) a folder beside the warehouse stands in for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when this process ends."""
    spark = df.sparkSession
    place = fresh_dir(spark, name)
    df.write.parquet(place)
    atexit.register(remove, spark, place)
    return spark.read.schema(df.schema).parquet(place)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more, or only what has been written already."""
    for df in tables:
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, place)


def remove(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the context may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that may be broadcast; rows of such tables here have at most some hundred bytes.
BROADCAST_ROWS = 20_000


def join_table(left: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """``left`` joined with a stored table whose keys may each hold a large share of ``left``.

    The table is broadcast if its rows, which are counted, are few. Otherwise each key of ``left`` is dealt into
    ``salts`` parts by the hash ``spread``, and the table's rows go to all of them.
    """
    if table.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """16 bytes that are equal for rows that agree in ``columns``, nulls told apart from all values."""
    parts = [F.concat(F.lit("\x01"), F.col(c).cast("string")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x00", *[F.coalesce(p, F.lit("\x02")) for p in parts]).cast("binary")))


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
