"""Session defaults. Cluster sizing stays with whoever submits the job."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skylattice", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Every hour in the library is a UTC hour."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a fresh folder on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="skylattice-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_TABLES: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read as a table in the checkpoint folder and read it
    back: its lineage ends there, a lost executor costs no recomputation, and its columns and
    size are known to the planner. ``drop_materialized`` removes the tables when their frames have
    been used."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end of the block the tables that ``materialize`` writes inside it, for blocks
    that store their result elsewhere."""
    before = set(_TABLES)
    try:
        yield
    finally:
        for path in [p for p in _TABLES if p not in before]:
            _TABLES.remove(path)
            remove_folder(spark, path)


def release(*frames: DataFrame) -> int:
    """Remove the materialized tables that the given frames read and return their number."""
    removed = 0
    for df in frames:
        folders = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
        for path in [p for p in _TABLES if p.rsplit("/", 1)[-1] in folders]:
            _TABLES.remove(path)
            removed += remove_folder(df.sparkSession, path)
    return removed


def remove_folder(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def drop_materialized(spark: SparkSession) -> int:
    """Remove the tables this process has written with ``materialize`` and return their number.
    Frames that were built on them can no longer be read."""
    removed = 0
    while _TABLES:
        removed += remove_folder(spark, _TABLES.pop())
    return removed
