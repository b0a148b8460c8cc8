"""SimHash near-duplicates by the Hamming ball of whole fingerprints.

There are no tables by segment: the fingerprint and its 64 neighbours with one bit turned are the keys
of the index, whatever SEGMENTS is. Two fingerprints meet under a
common key exactly when they differ in at most two bits, because the ball of one touches the ball
of the other half way. Under one key lie at most as many different fingerprints as a ball has
members (65), whatever the data holds: no bucket can run hot, nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.llm.components import components
from skylattice.llm.frames import fresh, own
from skylattice.session import materialize

BITS = 64
SEGMENTS = 4
MAX_DISTANCE = 2
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes, as an unsigned integer."""
    counts = np.zeros((8, 8), np.int64)  # bit in the byte, byte
    blocks = np.arange(0, len(hashes), 255)  # a byte lane holds a sum of 255 bits
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, blocks)
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if over[bit, byte])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text; 0 without words. Fewer words than a shingle are one."""
    words = (text or b"").lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], 42) for a, b in
         zip(starts.tolist(), ends[shingle - 1:].tolist())),
        np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def fingerprints(docs: DataFrame, *, shingle: int = 3, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long, of every row."""
    keep = keep or ["doc_id"]
    narrow = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def computed(batches):
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()),
                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*keep, "fp"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp long"
    return narrow.mapInArrow(computed, schema)


def _ball(fp: Column) -> Column:
    """The fingerprint and, segment by segment, itself with one bit of the segment turned."""
    width = BITS // SEGMENTS
    turned = [
        fp.bitwiseXOR(F.lit(int(np.uint64(1 << (segment * width + bit)).astype(np.int64))))
        for segment in range(SEGMENTS) for bit in range(width)
    ]
    return F.array(fp, *turned)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): from each distinct fingerprint to the smallest one under each of its keys, verified
    on all bits. Fingerprints two or fewer bits apart are connected through these links; a larger
    MAX_DISTANCE is refused, as the keys would miss links."""
    if MAX_DISTANCE > 2:
        raise ValueError("balls of radius one meet up to two bits apart only")
    distinct = prints.select("fp").distinct()
    index = distinct.select("fp", F.explode(_ball(F.col("fp"))).alias("key"))
    first = F.min("fp").over(Window.partitionBy("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    return (index.select(F.col("fp").alias("a"), first.alias("b"))
            .where(F.col("a") != F.col("b")).where(near))


def simhash_groups(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, text_key, fp, component_id, first_key) of every row. component_id is the smallest id
    reachable over links; null ids count only where a group has no other. first_key is the text
    hash of the group's first row (by id, then text hash), so (component_id, first_key) names one
    document of each group even if ids repeat. Null and wordless texts have fingerprint 0 and link
    like any other. Only distinct fingerprints are indexed and linked."""
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("text_key"))
    rows = materialize(fingerprints(keyed, shingle=shingle, text_col="text",
                                    keep=["id", "text_key"]))
    return named_groups(rows, links(rows), id_col)


def named_groups(rows: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows (id, text_key, fp) with component_id and first_key; the links (a, b) connect fps."""
    rooted = components(found)
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key"))
    firsts = rows.groupBy("fp").agg(least.alias("first"))
    groups = firsts.join(rooted, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = groups.groupBy("root").agg(F.min("first").alias("first"))
    label = materialize(groups.select("fp", "root").join(named, "root").select(
        "fp", F.col("first.id").alias("component_id"), F.col("first.text_key").alias("first_key")))
    return rows.join(label, "fp").select(
        F.col("id").alias(id_col), "text_key", "fp", "component_id", "first_key")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents with one row of each group left, the one with the smallest id. Rows repeated
    with the same id and text are one document; only if there are any is the text shuffled for it."""
    groups = simhash_groups(docs, shingle=shingle, id_col=id_col, text_col=text_col)
    return leave_first(docs, groups, id_col=id_col, text_col=text_col)


def leave_first(docs: DataFrame, groups: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The documents that are the first row of their group."""
    firsts = groups.where(
        F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    kept = materialize(firsts.groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"))
                       .agg(F.count("*").alias("n")))
    key = F.xxhash64(docs[text_col])
    found = docs.join(kept, docs[id_col].eqNullSafe(kept["_id"]) & (key == kept["_key"]), "left_semi")
    if kept.where("n > 1").limit(1).count():
        name = fresh(docs, "text_key")
        found = found.withColumn(name, F.xxhash64(text_col)).dropDuplicates([id_col, name])
    return found.select(*own(docs))
