"""File inventories and audits of the observation archive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skylattice.constants import FILE_SUFFIX, RAW_HEADER
from skylattice.operators.windows import ordinal
from skylattice.session import materialize

KNOWN_HEADER = ",".join(f'"{c}"' for c in RAW_HEADER)


def decoded(content: Column | str = "content") -> Column:
    """File content as text: UTF-8 where the bytes are valid, Latin-1 otherwise."""
    raw = F.col(content) if isinstance(content, str) else content
    as_utf8 = raw.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(raw, "ISO-8859-1"))


def archive_files(
    spark: SparkSession, root: str, pattern: str = "*" + FILE_SUFFIX, years=None
) -> DataFrame:
    """``path, length, content`` of the non-empty files. Years are part of the file name, so
    they narrow the listing and other files are never opened."""
    if years is not None:
        pattern = "{" + ",".join(str(y) for y in years) + "}" + pattern
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "length", "content")
    )


def _qualified(spark: SparkSession, root: str) -> str:
    """The root with the scheme that Spark's own readers would use for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def _file_system(root: str):
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//[^/]*)?(?=/)", "", root)
    return fs.FileSystem.from_uri(root)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row (``path`` below the root, ``content``) as one file; ``path, length`` of all.
    Tasks write where Spark's writers would choose the names themselves; a task that runs again
    writes the same files. A root without a scheme lies on the session's default file system."""
    root = _qualified(files.sparkSession, root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"path": batch["path"], "length": batch["content"].map(len)})

    return materialize(files.select("path", "content").mapInPandas(write, "path string, length bigint"))


def inventory(spark: SparkSession, root: str, suffix: str = FILE_SUFFIX) -> DataFrame:
    """``path, length`` of all files including empty ones, which Spark's readers leave out. Folders
    are listed level by level in tasks; the driver only learns whether another level follows. A root
    without a scheme lies on the session's default file system."""
    from pyarrow import fs

    root = _qualified(spark, root)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _file_system(root)
        for batch in batches:
            for folder in batch["path"]:
                found = system.get_file_info(fs.FileSelector(folder))
                yield pd.DataFrame(
                    [(i.path, i.size, i.type == fs.FileType.Directory) for i in found],
                    columns=["path", "length", "folder"],
                )

    tasks = spark.sparkContext.defaultParallelism * 4
    folders = spark.createDataFrame([(_file_system(root)[1],)], "path string")
    levels = []
    while levels == [] or not folders.isEmpty():
        level = materialize(
            folders.repartition(tasks, "path")
            .mapInPandas(children, "path string, length bigint, folder boolean")
        )
        levels.append(level.filter(~F.col("folder")).select("path", "length"))
        folders = level.filter("folder").select("path")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.filter(F.col("path").endswith(suffix))


def open_quote(text: Column) -> Column:
    """Whether a quote is never closed, which makes a file unreadable as CSV."""
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def _plain(path: Column) -> Column:
    """Path without the scheme, so listings and readers agree."""
    return F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")


def audit_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """``path, status, number``: empty, unreadable (nothing but blanks, or a quote that never
    closes) or ok; problem files are numbered by path within their status."""
    text = decoded()
    broken = ~text.rlike(r"\S") | open_quote(text)
    readable = contents.select(_plain(F.col("path")).alias("_p"), broken.alias("_broken"))
    listed = files.withColumn("_p", _plain(F.col("path")))
    status = (
        F.when(F.col("length") == 0, "empty")
        .when(F.coalesce("_broken", F.lit(True)), "unreadable").otherwise("ok")
    )
    judged = listed.join(readable, "_p", "left").select("path", status.alias("status"))
    bad = ordinal(judged.filter("status <> 'ok'"), "path", "number", ["status"])
    return bad.withColumn("number", F.col("number") + 1).unionByName(
        judged.filter("status = 'ok'").withColumn("number", F.lit(None).cast("long"))
    )


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def audit_headers(contents: DataFrame, header: str = KNOWN_HEADER) -> DataFrame:
    """``path, status``: whether the first line is exactly the known header."""
    first = F.trim(F.regexp_replace(F.substring_index(decoded(), "\n", 1), r"\s+$", ""))
    return contents.select(
        "path", F.when(first == header, "has_header").otherwise("missing_header").alias("status")
    )
