"""Hourly data as it arrives."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

OBS_SCHEMA = (
    "station_id string, source string, ts timestamp, lat double, lon double, alt double,"
    " temp double, humidity double, rain double, wind_dir double, wind_speed double,"
    " pressure double"
)


#: Event time of the row that closes a stream; readings are older.
CLOSED = "9999-01-01 00:00:00"


def close_arrivals(spark: SparkSession, path: str, schema: str = OBS_SCHEMA) -> None:
    """Put a last file into the arriving folder whose one row moves the watermark past every reading.
    The next run then gives out the hours still open; nothing is accepted after it."""
    kinds = spark.createDataFrame([], schema).schema
    row = [F.lit(CLOSED).cast(f.dataType).alias(f.name) if f.name == "ts"
           else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
    spark.range(1).select(*row).write.mode("append").parquet(path)


def stream_observations(
    spark: SparkSession, path: str, watermark: str = "2 hours", schema: str = OBS_SCHEMA,
    fmt: str = "parquet", max_files: int | None = None, order: str | None = None,
) -> DataFrame:
    """New rows below ``path``, one per station and hour. State older than the watermark is
    dropped, so it is bounded by the stations times the watermark; later rows are dropped too.

    Without ``order`` a row comes out as soon as it arrives, and of several for one station and hour
    the one that arrived first. With it, an hour comes out when the watermark has passed it, and
    then the row that is smallest by that column, as in the batch operator."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrived = reader.load(path).withWatermark("ts", watermark)
    keys = ["station_id", "ts"]
    if order is None:
        rows = arrived.dropDuplicatesWithinWatermark(keys)
    else:
        rest = [c for c in arrived.columns if c not in keys]
        first = F.min_by(F.struct(*rest), order).alias("_first")
        rows = arrived.groupBy(*keys).agg(first).select(*keys, "_first.*")
    # on the event time, so that it is applied after the watermark has seen the closing row
    return rows.filter(F.col("ts") < F.lit(CLOSED).cast("timestamp"))


def stream_hourly_stats(
    stream: DataFrame, cols: Iterable[str], window: str = "1 hour", by: str = "source"
) -> DataFrame:
    """``window_start, {by}, feature, n, mean, m2`` per closed window, ready for ``merge_stats``.
    The sums combine map-side and state holds one row per window and source."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"),
            (F.var_pop(c) * F.count(c)).alias(f"m2_{c}"),
        ]
    grouped = stream.groupBy(F.window("ts", window).alias("w"), by).agg(*aggs)
    parts = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"),
            F.col(f"mean_{c}").alias("mean"), F.col(f"m2_{c}").alias("m2"),
        )
        for c in cols
    ]
    return grouped.select(F.col("w.start").alias("window_start"), by, F.inline(F.array(*parts)))


def stream_hourly_rain(stream: DataFrame) -> DataFrame:
    """Rain of the hour from rain accumulated since midnight, as the batch operator computes it.
    The stream needs a watermark. A window of two hours per station holds an hour and the one before
    it; it closes, and its second hour comes out, when the watermark has passed both. Of several
    readings in an hour one counts, so take them from ``stream_observations``."""
    hour = F.date_trunc("hour", "ts")
    rows = stream.select("station_id", "ts", F.coalesce("rain", F.lit(0.0)).alias("rain"), hour.alias("_hour"))
    windows = rows.select("station_id", F.window("ts", "2 hours", "1 hour").alias("w"), "rain", "_hour")
    before = F.first(F.when(F.col("_hour") == F.col("w.start"), F.col("rain")), ignorenulls=True)
    own = F.first(F.when(F.col("_hour") != F.col("w.start"), F.col("rain")), ignorenulls=True)
    held = windows.groupBy("station_id", "w").agg(before.alias("_before"), own.alias("_own"))
    ts = F.col("w.end") - F.expr("INTERVAL 1 HOUR")
    since = F.when(F.hour(ts) == 0, F.lit(0.0)).otherwise(F.coalesce("_before", F.lit(0.0)))
    return held.filter("_own IS NOT NULL").select(
        "station_id", ts.alias("ts"), F.greatest(F.col("_own") - since, F.lit(0.0)).alias("rain")
    )


def write_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything that has arrived into a parquet table and read it back. Run again later
    with the same path, it continues where it stopped."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/_progress").option("path", f"{path}/rows").start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
