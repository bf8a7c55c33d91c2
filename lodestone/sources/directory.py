"""Text files of a directory tree as items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What is read by default, and folders of generated files.
EXTENSIONS = ("md", "markdown", "txt", "rst")
GENERATED = ("node_modules", "vendor", "target", "dist", "build", "__pycache__")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob; one without a slash is for the last part of a path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return ("^" if "/" in glob else "(^|/)") + out + "$"


def exclusion(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Why a relative path is not read, null if it is; the first reason that holds."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_pattern, globs)))
    wanted = any_of(include) if include else F.lower(path).rlike(rf"\.({'|'.join(EXTENSIONS)})$")
    return (
        F.when(F.array_contains(F.split(path, "/"), ".git"), "git_metadata")
        .when(any_of(exclude), "explicit_exclude")
        .when(path.rlike(r"(^|/)\."), "hidden")
        .when(F.exists(folders, lambda x: x.isin(*GENERATED)), "generated_directory")
        .when(~wanted, "not_included")
    )


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), content, length, captured_at, reason; contents of excluded files are never read by later projections.

    Spark lists no names that begin with a dot or an underscore, so most hidden files don't even show up.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), "^" + re.escape(base) + "/", "")
    return files.select(path.alias("path"), "content", "length", F.unix_micros("modificationTime").alias("captured_at")).withColumn("reason", exclusion(F.col("path"), include, exclude))


def select(files: DataFrame, file_bytes: int = 16 << 20, total_bytes: int = 1 << 30, entries: int = 100_000) -> DataFrame:
    """Included files as items (item, text, captured_at); anything over a limit or not UTF-8 is an error, never cut short."""
    kept = files.where("reason is null")
    totals = kept.agg(F.sum("length").alias("_bytes"), F.count("*").alias("_n"))
    checked = kept.crossJoin(F.broadcast(totals))  # one row
    text = (
        F.when(F.col("length") > file_bytes, F.raise_error(F.concat(F.lit("file too large: "), "path")))
        .when(F.col("_bytes") > total_bytes, F.raise_error(F.lit("too many bytes")))
        .when(F.col("_n") > entries, F.raise_error(F.lit("too many files")))
        .when(~F.is_valid_utf8(F.col("content").cast("string")), F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
        .otherwise(F.col("content").cast("string"))
    )
    return checked.select(F.col("path").alias("item"), text.alias("text"), "captured_at")


def preview(files: DataFrame) -> DataFrame:
    """What a sync would read and skip, without reading it."""
    return files.select("path", "length", F.coalesce("reason", F.lit("selected")).alias("verdict"))


def against_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem of files that a manifest (path, sha256) lacks, misses or contradicts."""
    have = files.select("path", F.sha2("content", 256).alias("_have"))
    both = have.join(manifest, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def running_bytes(files: DataFrame) -> DataFrame:
    return files.withColumn("running", F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)))
