"""Reading and writing parameters, graphs, sequences, cubes, reports and run logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skylattice.constants import METRICS, UNITS
from skylattice.operators.graph import Graph
from skylattice.operators.windows import chunk_sequences, manifest

PARAMS_JSON = "map<string,struct<mean:double,std:double>>"


def save_norm_params(params: DataFrame, path: str) -> None:
    """One JSON object ``{feature: {mean, std}}``; there is one entry per feature."""
    entry = F.struct("feature", F.struct("mean", "std"))
    text = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry))))
    params.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_norm_params(spark: SparkSession, path: str) -> DataFrame:
    """``feature, mean, std`` from a file or folder written as above."""
    text = spark.read.text(path, wholetext=True)
    table = F.from_json("value", PARAMS_JSON)
    return text.select(F.explode(table).alias("feature", "p")).select("feature", "p.mean", "p.std")


def _write_by_date(df: DataFrame, path: str, mode: str, ts: str = "ts") -> None:
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_graph(graph: Graph, path: str, mode: str = "overwrite") -> None:
    for name in ("nodes", "edges", "meta"):
        _write_by_date(getattr(graph, name), f"{path}/{name}", mode)


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "meta")])


def write_chunks(seqs: DataFrame, path: str, chunk_size: int = 50) -> DataFrame:
    """Sequences by chunk, and a manifest table made from the chunk assignment itself."""
    chunks = chunk_sequences(seqs, chunk_size)
    chunks.hint("rebalance", "chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(
        f"{path}/sequences"
    )
    listing = manifest(seqs.sparkSession.read.parquet(f"{path}/sequences"))
    listing.write.mode("overwrite").parquet(f"{path}/manifest")
    return seqs.sparkSession.read.parquet(f"{path}/manifest")


def prediction_cube(cube: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cube (in physical units) with station positions, units, ISO times and a validity flag."""
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return cube.join(catalog, "station_id", "left").withColumns(
        {
            "unit": F.try_element_at(table, F.col("variable")),
            "time_str": F.date_format("ts_valid", "yyyy-MM-dd'T'HH:mm'Z'"),
            "valid": F.col("y_true").isNotNull(),
        }
    )


def write_prediction_cube(
    cube: DataFrame, catalog: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    _write_by_date(prediction_cube(cube, catalog), path, mode, "ts_valid")


def write_report(df: DataFrame, path: str) -> None:
    """A result table as CSV with headers: one file if it is small, several if it is not."""
    df.hint("rebalance").write.mode("overwrite").csv(path, header=True)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, line_no, epoch, stage`` and the metrics. The first three lines describe the run,
    the fourth names the columns; only train, val and test rows are kept, and a missing epoch is
    that of the row before. A run is named by its path below ``path`` (the file name of a single
    file). A log is one small file, so it stays one row until it is split."""
    root = re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", path).rstrip("/")
    place = F.regexp_replace(
        F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")),
        r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    below = F.when(place.startswith(root + "/"), F.substring(place, len(root) + 2, 1 << 20)).otherwise(
        F.regexp_extract(place, r"([^/]+)$", 1))
    reader = spark.read.option("recursiveFileLookup", "true")
    logs = reader.text(path, wholetext=True).select(
        below.alias("run_id"),
        F.split("value", "\r?\n").alias("_lines"),
    )
    names = F.transform(
        F.split(F.col("_lines")[3], ","),
        lambda n: F.lower(F.trim(F.regexp_replace(F.trim(n), "^#+", ""))),
    )
    rows = (
        logs.withColumn("_names", names)
        .select("run_id", "_names", F.posexplode("_lines").alias("line_no", "_line"))
        .filter("line_no > 3")
        .withColumn("_cells", F.split("_line", ","))
    )

    def cell(name: str):
        position = F.nullif(F.array_position("_names", F.lit(name)), F.lit(0)).cast("int")
        return F.trim(F.try_element_at("_cells", position))

    typed = rows.select(
        "run_id", "line_no", cell("epoch").try_cast("double").cast("int").alias("epoch"),
        cell("stage").alias("stage"), *[cell(m).try_cast("double").alias(m) for m in METRICS],
    ).filter(F.col("stage").isin("train", "val", "test"))
    before = Window.partitionBy("run_id").orderBy("line_no")
    return typed.withColumn("epoch", F.last("epoch", ignorenulls=True).over(before))
