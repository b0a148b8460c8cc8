"""Indexes, sliding sequences, splits and chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.constants import FEATURE_COLUMNS
from skylattice.session import materialize


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(row))


def ordinal(df: DataFrame, key: str, name: str, by: Iterable[str] = ()) -> DataFrame:
    """0-based position of each row in the order of ``key``, within ``by``.

    Rows are range-sorted once and numbered inside their partitions; what is ordered as a whole is
    one row per partition and group met. No task sees a group, and no key needs a prefix."""
    by = list(by)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *by, key).sortWithinPartitions(*by, key)
    placed = materialize(ranged.withColumn("_spot", F.monotonically_increasing_id()))
    part = F.shiftright("_spot", 33)
    firsts = placed.groupBy(*by, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_spot").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = firsts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], "_part", "_first",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    same = part == shifts["_part"]
    for c in by:
        same = same & placed[c].eqNullSafe(shifts[f"_by_{c}"])
    return placed.join(shifts, same).select(
        *df.columns, (F.col("_shift") + F.col("_spot") - F.col("_first")).alias(name))


def node_index(*frames: DataFrame) -> DataFrame:
    """``station_id, node_idx``: dense 0-based index over the sorted union of the stations."""
    ids = frames[0].select("station_id")
    for frame in frames[1:]:
        ids = ids.unionByName(frame.select("station_id"))
    return ordinal(ids.distinct(), "station_id", "node_idx")


def node_catalog(obs: DataFrame) -> DataFrame:
    """First reported position of each station."""
    place = F.min_by(F.struct("lat", "lon", "alt"), F.struct("ts", "lat", "lon", "alt"))
    return obs.groupBy("station_id").agg(place.alias("p")).select(
        "station_id", "p.lat", "p.lon", "p.alt"
    )


def snapshots(df: DataFrame) -> DataFrame:
    """``ts, i``: the distinct hours in order."""
    return ordinal(df.select("ts").distinct(), "ts", "i")


def sliding_windows(
    df: DataFrame, window: int = 48, stride: int = 12, horizon: int = 6, contiguous: bool = False
) -> DataFrame:
    """``start, step, role, ts``: every ``stride`` snapshots a run of ``window`` input steps and
    ``horizon`` target steps. Positions count reported hours; ``contiguous`` keeps only runs
    without a missing hour. Each hour lists the runs it belongs to, so nothing is joined."""
    length = window + horizon
    hours = snapshots(df)
    total = hours.agg(F.count(F.lit(1)).alias("_total"))
    i = F.col("i")
    first = F.greatest(F.ceil((i - F.lit(length - 1)) / F.lit(stride)), F.lit(0))
    last = F.least(
        F.floor(i / F.lit(stride)), F.floor((F.col("_total") - F.lit(length)) / F.lit(stride))
    )
    runs = (
        one_row(hours, total)
        .withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
        .filter("_first <= _last")
        .select("ts", "i", F.explode(F.sequence("_first", "_last")).alias("_run"))
    )
    start = F.col("_run") * F.lit(stride)
    steps = runs.select(
        start.alias("start"), (i - start).cast("int").alias("step"),
        F.when(i - start < window, F.lit("input")).otherwise(F.lit("target")).alias("role"), "ts",
    )
    if not contiguous:
        return steps
    run = Window.partitionBy("start")
    span = F.unix_timestamp(F.max("ts").over(run).cast("timestamp")) - F.unix_timestamp(
        F.min("ts").over(run).cast("timestamp")
    )
    return steps.withColumn("_span", span).filter(
        F.col("_span") == F.lit((length - 1) * 3600)
    ).drop("_span")


def window_targets(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col("role") == "target")


def sequence_id(windows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add ``seq_id`` (first and last input hour as ``yyyyMMddHH_yyyyMMddHH``) and ``input_end``;
    sequences already listed in ``existing`` are left out. A run has window + horizon rows."""
    run = Window.partitionBy("start")
    end = F.max(F.when(F.col("role") == "input", F.col("ts"))).over(run)
    stamp = "yyyyMMddHH"
    named = windows.withColumn("input_end", end).withColumn(
        "seq_id",
        F.concat_ws("_", F.date_format(F.min("ts").over(run), stamp), F.date_format("input_end", stamp)),
    )
    if existing is not None:
        named = named.join(existing.select("seq_id").distinct(), "seq_id", "left_anti")
    return named


def sequence_rows(windows: DataFrame, features: DataFrame) -> DataFrame:
    """The reported feature rows of every step."""
    return windows.join(features, "ts")


def densify(
    windows: DataFrame, features: DataFrame, index: DataFrame, cols: Iterable[str]
) -> DataFrame:
    """Every step of a sequence by every station that reports in any of its steps: a station is
    zero with ``present`` false in the steps it misses. Stations that are absent from the whole
    sequence have no rows, so the result grows with the readings and not with the index."""
    cols = list(cols)
    reported = features.select("ts", "station_id", *cols).join(index, "station_id").select(
        "ts", "node_idx", F.lit(True).alias("_here"), *cols
    )
    members = windows.select("start", "ts").join(
        reported.select("ts", "node_idx"), "ts").select("start", "node_idx").distinct()
    return (
        windows.join(members, "start").join(reported, ["ts", "node_idx"], "left")
        .withColumn("present", F.coalesce("_here", F.lit(False))).drop("_here")
        .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})
    )


def reindex_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Station names at both ends replaced by their global index."""
    ends = [
        index.select(F.col("station_id").alias(c), F.col("node_idx").alias(f"{c}_idx"))
        for c in ("src", "dst")
    ]
    return edges.join(ends[0], "src").join(ends[1], "dst").drop("src", "dst")


def sequence_edges(windows: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """``seq_id, step, src_idx, dst_idx`` and the attributes: the edges of the hour of every step,
    ends as positions in the index. Edges are re-indexed once, before the sequences fan out."""
    steps = windows.select("seq_id", "step", "ts")
    return steps.join(reindex_edges(edges, index), "ts").drop("ts")


def chunk_sequences(seqs: DataFrame, size: int = 50) -> DataFrame:
    """Add the 1-based ``chunk_id`` of each sequence over the sorted ids."""
    ids = seqs.select("seq_id").distinct()
    placed = ordinal(ids, "seq_id", "_i")
    chunk = (F.floor(F.col("_i") / F.lit(size)) + 1).cast("int")
    return seqs.join(placed.select("seq_id", chunk.alias("chunk_id")), "seq_id")


def manifest(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "seq_id").distinct()


def chronological_split(
    windows: DataFrame, train_end: str = "2023-01-01", val_end: str = "2024-01-01",
    test_end: str = "2025-01-01",
) -> DataFrame:
    """Add ``split`` by the hour after the last input: before ``train_end`` train, before
    ``val_end`` val, before ``test_end`` test; anything later is an error."""
    first_target = F.col("input_end") + F.expr("INTERVAL 1 HOUR")

    def before(limit: str) -> Column:
        return first_target < F.lit(limit).cast("timestamp")

    late = F.raise_error(F.concat(F.lit("sequence after the test period: "), F.col("seq_id")))
    split = (
        F.when(before(train_end), "train").when(before(val_end), "val")
        .when(before(test_end), "test").otherwise(late.cast("string"))
    )
    return windows.withColumn("split", split)


def select_channels(
    seq: DataFrame, inputs: Iterable[int], targets: Iterable[int],
    columns: Iterable[str] = FEATURE_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """Input rows with the input features and target rows with the target features, both given
    by position in ``columns``."""
    columns = list(columns)
    keep = [c for c in seq.columns if c not in columns]

    def side(role: str, positions: Iterable[int]) -> DataFrame:
        return seq.filter(F.col("role") == role).select(*keep, *[columns[p] for p in positions])

    return side("input", inputs), side("target", targets)
