"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import re
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder beside the warehouse only where that is unset, with a warning on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            warnings.warn(f"spark.checkpoint.dir is unset: {place} must be a folder that all executors share", stacklevel=2)
    return place.rstrip("/")


def remove(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the context may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that one computation writes and reads again; ``close`` removes them, the end of the process those that are left."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.place = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.place)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def close(self) -> None:
        remove(self.spark, self.place)


def fingerprint(df: DataFrame) -> str:
    """Of the folders of the files that ``df`` reads: names, lengths and times, so that a file rewritten under its name shows."""
    spark = df.sparkSession
    digest = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
        digest.update("\n".join(sorted(found)).encode())
    return digest.hexdigest()


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Makes a file whole or not at all; False if there is one already, also if another process makes it at the same time."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(staged, False)
    out.write(data)
    out.close()
    try:
        if fs.getScheme() == "file":  # a rename there would replace the other's file
            try:
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        try:
            none = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.NONE.getClass(), 0)
            hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass()):
                raise
            return False
        return True
    finally:
        fs.delete(staged, False)
