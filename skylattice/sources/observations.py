"""Reading and writing station observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skylattice.constants import FILE_SUFFIX, RAW_TO_CANONICAL
from skylattice.operators.quality import exclude_paths, file_timestamp
from skylattice.sources.files import archive_files, decoded, open_quote

#: Stand for a line break and a comma inside quotes while a file is split; private characters.
BREAK, COMMA = "\ue000", "\ue001"


def _lines(text: Column) -> Column:
    """Lines of a file. Every second part between quotes is quoted: its line breaks end no line and
    its commas no field. One pass over the text marks both."""
    parts = F.split(text, '"', -1)
    kept = F.transform(parts, lambda p, i: F.when(
        i % 2 == 1, F.replace(F.regexp_replace(p, "\r?\n", BREAK), F.lit(","), F.lit(COMMA))).otherwise(p))
    return F.split(F.array_join(kept, '"'), "\r?\n")


def _fields(line: Column) -> Column:
    """Fields of a line that ``_lines`` has marked."""
    def unquoted(f: Column) -> Column:
        inner = F.replace(F.regexp_replace(f, r'^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"'))
        return F.translate(inner, BREAK + COMMA, "\n,")

    return F.transform(F.split(line, ",", -1), unquoted)


def rejected_files(contents: DataFrame) -> DataFrame:
    """``path, reason`` of the files that ``parse_observations`` leaves out."""
    header = F.transform(_fields(F.col("_first")), lambda f: F.trim(f))
    reason = (
        F.when(F.col("ts").isNull(), "no_hour").when(open_quote(decoded()), "open_quote")
        .when(~F.array_contains(header, "Font"), "no_header")
    )
    return (
        contents.withColumn("ts", file_timestamp("path"))
        .withColumn("_first", _lines(F.regexp_replace(decoded(), "^\ufeff", ""))[0])
        .select("path", reason.alias("reason")).filter("reason is not null")
    )


def parse_observations(contents: DataFrame) -> DataFrame:
    """One text row per data line of each file: ``path, line_no, ts, has_pressure`` and the
    canonical columns, found by the file's own header. A line break inside quotes belongs to its
    field. Lines with more fields than the header are skipped, shorter ones padded with nulls; files
    with a quote left open, without a source column or with a name that is no hour are rejected
    (``rejected_files`` names them). Everything is a column expression on the file's bytes, so files
    of different encodings and headers share one scan."""
    lines = _lines(F.regexp_replace(decoded(), "^\ufeff", ""))
    names = F.transform(_fields(F.col("_header")), lambda f: F.trim(f))
    rows = (
        contents.withColumn("ts", file_timestamp("path")).filter("ts is not null")
        .filter(~open_quote(decoded()))
        .select("path", "ts", lines.alias("_lines"))
        .withColumn("_header", F.col("_lines")[0]).withColumn("_names", names)
        .filter(F.array_contains("_names", "Font"))
        .select("path", "ts", "_names", F.posexplode("_lines").alias("line_no", "_line"))
        .filter((F.col("line_no") > 0) & (F.trim("_line") != ""))
        .withColumn("_fields", _fields(F.col("_line")))
        .filter(F.size("_fields") <= F.size("_names"))
    )

    def value(raw: str) -> Column:
        position = F.array_position("_names", F.lit(raw))
        cell = F.try_element_at("_fields", F.nullif(position, F.lit(0)).cast("int"))
        return F.when(~cell.isin("", " "), cell)

    return rows.select(
        "path", "line_no", "ts", F.array_contains("_names", "Patm").alias("has_pressure"),
        *[value(raw).alias(ours) for raw, ours in RAW_TO_CANONICAL.items()],
    )


def read_observations(
    spark: SparkSession, root: str, pattern: str = "*" + FILE_SUFFIX, years=None
) -> DataFrame:
    """All readings below ``root`` outside excluded folders, as text."""
    files = exclude_paths(archive_files(spark, root, pattern, years), "cleaning", root=root)
    return parse_observations(files)


def _by_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
    )


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year, month and day. The rebalance hint lets Spark split a crowded day over
    several files and gather sparse ones."""
    days = ["year", "month", "day"]
    _by_day(df).hint("rebalance", *days).write.mode(mode).partitionBy(*days).parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
