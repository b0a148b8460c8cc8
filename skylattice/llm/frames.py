"""Column helpers for frames whose other columns are not known."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of whole texts that travel to Python at once.
TEXT_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block send texts to Python in small batches, so that long texts do not
    add up in memory."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def own(df: DataFrame) -> list[Column]:
    """All columns of a frame by name, whatever characters the names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
