"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every text hashes to a place on the ring and belongs to the next virtual node clockwise; what a
full shard cannot take goes on clockwise to the next shard with room. The flow is settled on the
arcs between virtual nodes, whose number is shards x nodes whatever the data, and every row finds
its shard from its rank along the ring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skylattice.session import materialize


def virtual_nodes(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed ring places in order, and the shard of each."""
    places = {}
    for shard in range(shards):
        for node in range(nodes):
            place = np.uint64(xxhash.xxh64_intdigest(f"{shard}/{node}")).astype(np.int64)
            places.setdefault(int(place), shard)
    order = sorted(places)
    return np.array(order, np.int64), np.array([places[p] for p in order], np.int64)


def capacities(rows: int, shards: int, slack: float) -> np.ndarray:
    """Without slack the counts are at most one apart and add up to the rows."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)), np.int64)
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def settle(loads: np.ndarray, owners: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int]]:
    """(first rank, rank after, shard) pieces of the rows in ring order.

    `loads` counts the rows of each arc; the last one lies beyond the last virtual node and so
    belongs to the first. Every arc first fills its own shard in ring order; what is left then
    walks on clockwise past full shards."""
    room, n = room.copy(), len(owners)
    firsts = np.concatenate([[0], np.cumsum(loads)])
    pieces, waiting = [], []
    for arc, load in enumerate(loads):
        shard = owners[arc % n]
        take = int(min(load, room[shard]))
        if take:
            pieces.append((int(firsts[arc]), int(firsts[arc]) + take, int(shard)))
            room[shard] -= take
        if take < load:
            waiting.append((arc % n, int(firsts[arc]) + take, int(firsts[arc + 1])))
    onward = list(range(1, n + 1))  # next node clockwise that may have room

    def follow(node: int) -> int:
        path = []
        while room[owners[node]] == 0:
            path.append(node)
            node = onward[node] % n
        for p in path:
            onward[p] = node
        return node

    for node, first, last in waiting:
        while first < last:
            node = follow(node)
            shard = owners[node]
            take = int(min(last - first, room[shard]))
            pieces.append((first, first + take, int(shard)))
            room[shard] -= take
            first += take
    return sorted(pieces)


def shard_documents(docs: DataFrame, shards: int, *, nodes: int = 64, slack: float = 0.0,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slots count from 0 within a shard.

    Equal texts lie side by side on the ring and part only where a shard is full, so a group of
    any size is split over as many shards as it needs. Null texts share one place, apart from
    empty ones; null ids come first within a place. Equal rows are interchangeable. The rows are
    range-sorted by place once; ranks come from partition counts, and the driver sees one number
    per (partition, arc) met."""
    spark = docs.sparkSession
    places, owners = virtual_nodes(shards, nodes)
    text = F.col(text_col)
    keyed = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("place"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (keyed.repartitionByRange(parts, "place", "id", "size", "text_crc32")
               .sortWithinPartitions("place", "id", "size", "text_crc32"))

    @F.pandas_udf("long")
    def arc_of(place):
        import pandas as pd

        return pd.Series(np.searchsorted(places, place.to_numpy()))

    # partition number in the high bits, rank inside the partition in the low 33
    table = materialize(ordered.withColumn("spot", F.monotonically_increasing_id())
                        .withColumn("arc", arc_of("place")))
    part = F.shiftright("spot", 33)
    counts = table.groupBy(part.alias("part"), "arc").count().collect()
    loads = np.zeros(len(owners) + 1, np.int64)
    sizes = np.zeros(max((row["part"] for row in counts), default=0) + 1, np.int64)
    for row in counts:
        loads[row["arc"]] += row["count"]
        sizes[row["part"]] += row["count"]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    pieces = settle(loads, owners, capacities(int(loads.sum()), shards, slack))
    starts = np.array([p[0] for p in pieces], np.int64)
    shard_of = np.array([p[2] for p in pieces], np.int64)
    filled, slots = np.zeros(shards, np.int64), np.zeros(len(pieces), np.int64)
    for i, (first, last, shard) in enumerate(pieces):
        slots[i] = filled[shard]
        filled[shard] += last - first
    id_type = docs.schema[id_col].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            spot = np.asarray(batch.column(3))
            rank = offsets[spot >> 33] + (spot & ((1 << 33) - 1))
            at = np.searchsorted(starts, rank, side="right") - 1
            if len(rank):
                shard, slot = shard_of[at], slots[at] + rank - starts[at]
            else:
                shard = slot = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(shard.astype(np.int32)), pa.array(slot)],
                names=[id_col, "size", "text_crc32", "shard", "slot"])

    schema = f"`{id_col}` {id_type}, size long, text_crc32 long, shard int, slot long"
    return table.select("id", "size", "text_crc32", "spot").mapInArrow(placed, schema)
