"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

No pair that similar is missed. Candidates come first from operator 8: fingerprints of the shingles
that differ in two bits or fewer. They come then from an index. The shingles of every text are put in one
order, and a text is indexed under its first fifth: two texts that similar share at least one key.
The order takes rare shingles first, so that common lines are hardly ever keys; how common a shingle
is comes from a table of counts that only decides the order, never the result. Texts with the same
set are one node.

Under a key, every node is held against two of the key's nodes, others in each round, until a round
finds nothing or few pairs of different groups are left; those are compared one by one. A group of
any size is so linked by about as many pairs as it has keys. All links are verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.buffers import chunks, flat, lower, mixed, spans, word_hashes
from skylattice.llm.components import components
from skylattice.llm.frames import text_batches
from skylattice.llm.simhash import majority, leave_first, links as simhash_links, named_groups
from skylattice.session import materialize, release

SHINGLE = 5
#: Least similarity, as a fraction.
ALIKE, OF = 4, 5
#: Cells of the table of shingle counts, and how many of them travel together.
CELLS, SLICE = 1 << 20, 1 << 12
#: Bits of the map of values that a join can meet; a full map only lets more rows into the join.
MAP_BITS = 1 << 25
#: Longs of a set's parity signature, and of its fold that travels with each key.
SIGNS, FOLDED = 8, 2
#: Tasks whose counts one task adds up.
FAN_IN = 64
#: Pairs left for each posting at which comparing one by one is cheaper than another round, and the
#: share of compared pairs that must be links for another round.
FEW, SHARE = 4, 1 / 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _sets(texts: pa.Array, shingle: int):
    """(first row, end row, row of each shingle, shingles): the distinct shingles of each row, in
    ascending order. A text with fewer words than a shingle is one; without words it has none."""
    data, offsets = flat(texts)
    for a, b, part, ends in chunks(data, offsets):
        low = lower(part)
        starts, stops, rows = spans(low, ends)
        words = np.bincount(rows, minlength=b - a)
        short = np.where(words > 0, np.maximum(shingle - words, 0), 0)  # padded with zeros
        before = np.cumsum(short) - short
        size = words + short
        padded = np.zeros(size.sum(), np.uint64)
        padded[np.arange(len(rows)) + before[rows]] = word_hashes(low, starts, stops)
        first = np.repeat(np.arange(b - a), size)
        values = np.zeros(max(0, len(padded) - shingle + 1), np.uint64)
        for k in range(shingle):
            values = mixed(values * _FACTOR + padded[k:k + len(values)] + np.uint64(1))
        whole = first[:len(values)] == first[shingle - 1:]
        row, values = first[:len(values)][whole], values[whole]
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        yield a, b, row[new], values[new]


def _nodes(rows: int, row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each row's shingles and a 64-bit hash of its set."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    raw = values.tobytes()
    digests = (xxhash.xxh64_intdigest(raw[8 * s:8 * e], 42) for s, e in zip(bounds[:-1], bounds[1:]))
    return bounds, np.fromiter(digests, np.uint64, rows).view(np.int64)


def _table(docs: DataFrame, common, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_key, fp, print, n, keys, signs) of every row: the hash of its set, its SimHash
    fingerprint, the size of the set, its keys in the common order and the set's parity signature."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                        F.col(text_col).cast("binary").alias("text"))

    def computed(batches):
        cells = common.value
        for batch in batches:
            for a, b, row, values in _sets(batch.column(2), shingle):
                bounds, node = _nodes(b - a, row, values)
                n = np.diff(bounds)
                prints = np.array([majority(values[s:e]) if e > s else 0
                                   for s, e in zip(bounds[:-1], bounds[1:])], np.uint64)
                order = np.lexsort((values, cells[values % np.uint64(CELLS)], row))
                at = np.arange(len(row)) - bounds[row]
                # a set of fewer than ALIKE is only like itself
                take = (at <= n[row] + (-ALIKE * n[row]) // OF) & (n[row] >= ALIKE)
                held = np.searchsorted(row[take], np.arange(b - a + 1)).astype(np.int32)
                cell = ((values >> np.uint64(40)) % np.uint64(64 * SIGNS)).astype(np.int64)
                odd = np.bincount(row * (64 * SIGNS) + cell, minlength=(b - a) * 64 * SIGNS) & 1
                signs = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node),
                     pa.array(prints.view(np.int64)), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(held), pa.array(values[order][take].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SIGNS),
                                              pa.array(signs.reshape(-1).view(np.int64)))],
                    names=["id", "text_key", "fp", "print", "n", "keys", "signs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed.mapInArrow(computed, f"id {kind}, text_key long, fp long, print long, n int, "
                                      "keys array<long>, signs array<long>")


def _commonness(texts: DataFrame, shingle: int) -> np.ndarray:
    """Binary logarithm, rounded up, of the number of shingles in each cell."""

    def packed(counts: np.ndarray) -> pa.Array:
        return pa.array([pa.compress(counts.tobytes(), "lz4", asbytes=True)], pa.binary())

    def counted(batches):
        cells = np.zeros(CELLS, np.uint64)
        for batch in batches:
            for _, _, _, values in _sets(batch.column(0), shingle):
                cells += np.bincount(values % np.uint64(CELLS), minlength=CELLS).astype(np.uint64)
        cut = [(k, cells[k * SLICE:(k + 1) * SLICE]) for k in range(CELLS // SLICE)]
        cut = [(k, packed(part)) for k, part in cut if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in cut], pa.int32()),
             pa.concat_arrays([pa.array([], pa.binary()), *(p for _, p in cut)])], names=["slice", "blob"])

    def added(table):
        total = np.zeros(SLICE, np.uint64)
        for blob in table["blob"]:
            total += np.frombuffer(pa.decompress(blob.as_py(), SLICE * 8, "lz4", asbytes=True), np.uint64)
        return pa.table({"part": table["part"][:1], "slice": table["slice"][:1], "blob": packed(total)})

    sums = texts.mapInArrow(counted, "slice int, blob binary").withColumn("part", F.spark_partition_id())
    for step in range(3):  # added up in a tree, so that no task gathers all tasks' counts
        part = (F.col("part") / FAN_IN).cast("int") if step < 2 else F.lit(0)
        sums = sums.withColumn("part", part).groupBy("slice", "part").applyInArrow(
            added, "part int, slice int, blob binary")
    out = np.zeros(CELLS, np.uint8)
    for row in sums.toLocalIterator():
        total = np.frombuffer(pa.decompress(bytes(row["blob"]), SLICE * 8, "lz4", asbytes=True), np.uint64)
        out[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.ceil(np.log2(total + 1))
    return out


def _met(values: DataFrame, column: str) -> np.ndarray:
    """A map with the bit of every value set, as bytes."""
    at = F.pmod(F.col(column), F.lit(MAP_BITS))
    parts = values.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(MAP_BITS // 8 + 4096, np.uint8)  # parts of 4,096 bytes, from number 0 or 1
    for part, bits in parts.toLocalIterator():
        out[part * 4096:(part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the map has the bit of each value, placed as Spark's bitmap functions place it."""
    at = values % MAP_BITS  # the sign of the divisor, as pmod
    part = np.where(at > 0, 1 + (at - 1) // 32768, 0)
    place = np.where(at > 0, (at - 1) % 32768, 0)
    return (bits[part * 4096 + place // 8] >> (place % 8).astype(np.uint8)) & 1 > 0


def _postings(rows: DataFrame, met) -> DataFrame:
    """(key, node, n, at, signature) of the keys that the map has."""

    def computed(batches):
        bits = met.value
        for batch in batches:
            keys = batch.column(2)
            of = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy())
            key = keys.flatten().to_numpy()
            at = np.arange(len(key)) - np.searchsorted(of, np.arange(batch.num_rows))[of]
            take = np.flatnonzero(_has(bits, key))
            signs = batch.column(3).flatten().to_numpy().reshape(-1, SIGNS // FOLDED, FOLDED)
            signs = np.bitwise_xor.reduce(signs, axis=1)[of[take]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[take]), batch.column(0).take(pa.array(of[take])),
                 batch.column(1).take(pa.array(of[take])), pa.array(at[take].astype(np.int32)),
                 *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(FOLDED))],
                names=["key", "node", "n", "at", *(f"s{k}" for k in range(FOLDED))])

    signs = "".join(f", s{k} long" for k in range(FOLDED))
    return rows.where(F.size("keys") > 0).select(F.col("fp").alias("node"), "n", "keys", "signs").mapInArrow(
        computed, "key long, node long, n int, at int" + signs)


def _whole_sets(docs: DataFrame, wanted, text_col: str, shingle: int) -> DataFrame:
    """(node, items) of the texts whose hash the map has."""
    keyed = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))

    def computed(batches):
        for batch in batches:
            some = np.flatnonzero(_has(wanted.value, batch.column(0).to_numpy()))
            for a, b, row, values in _sets(batch.column(1).take(pa.array(some)), shingle):
                bounds, node = _nodes(b - a, row, values)
                items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), items], names=["node", "items"])

    return keyed.mapInArrow(computed, "node long, items array<long>")


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The pairs (a, b), a table, whose whole sets are similar enough."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = rows.join(nodes, rows["fp"] == nodes["node"]).groupBy("node").agg(F.min("text_key").alias("text_key"))
    wanted = docs.sparkSession.sparkContext.broadcast(_met(texts, "text_key"))
    sets = materialize(_whole_sets(docs, wanted, text_col, shingle).join(nodes, "node", "left_semi")
                       .groupBy("node").agg(F.first("items").alias("items")))
    of = lambda name, items: sets.select(F.col("node").alias(name), F.col("items").alias(items))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    found = materialize(found.where(both * (ALIKE + OF) >= (F.size("x") + F.size("y")) * ALIKE).select("a", "b"))
    release(nodes, sets)
    return found


def _apart(longs: int) -> Column:
    """Bits in which the signatures of x and y differ: each stands for a shingle that only one has."""
    return sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(longs)), F.lit(0))


def _possible(longs: int) -> Column:
    """Whether sizes, places under a key and signatures of x and y leave room for the similarity."""
    n = {s: F.col(f"{s}.n") for s in "xy"}
    at = {s: F.col(f"{s}.at") for s in "xy"}
    total = n["x"] + n["y"]
    most = F.least(at["x"], at["y"]) + F.least(n["x"] - at["x"], n["y"] - at["y"])
    return ((F.least(n["x"], n["y"]) * OF >= F.greatest(n["x"], n["y"]) * ALIKE)
            & (most * (ALIKE + OF) >= total * ALIKE)
            & (_apart(longs) * (ALIKE + OF) <= total * (OF - ALIKE)))


def _print_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints operator 8 links, one node for each fingerprint, and those with
    the same fingerprint as another. Sets too small to be similar to others are left out."""
    large = rows.where(F.col("n") >= ALIKE)
    least = materialize(large.groupBy("print").agg(F.min("fp").alias("least")))
    same = large.select("fp", "print").distinct().join(least, "print").select(
        F.col("least").alias("a"), F.col("fp").alias("b"))
    of = lambda name, node: least.select(F.col("print").alias(name), F.col("least").alias(node))
    linked = simhash_links(least.select(F.col("print").alias("fp"))).join(
        of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(linked)


def _star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with the one that looks most like it among two nodes of other groups under each
    of its keys. The two are drawn by a hash; in odd turns they are of the key's least and greatest
    group."""
    drawn = F.xxhash64("node", "key", F.lit(turn))
    by = F.struct("root", drawn.alias("drawn")) if turn % 2 else F.struct(drawn.alias("drawn"))
    end = F.struct("root", "node", "n", "at", *(f"s{k}" for k in range(FOLDED)))
    ends = placed.groupBy("key").agg(F.min_by(end, by).alias("p"), F.max_by(end, by).alias("q"))
    ends = ends.select("key", F.explode(F.array("p", "q")).alias("y")).select("key", "y.*")
    met = placed.alias("x").join(ends.alias("y"), F.col("x.key") == F.col("y.key"))
    met = met.where((F.col("x.root") != F.col("y.root")) & _possible(FOLDED))
    return met.groupBy(F.col("x.node").alias("a")).agg(
        F.min_by("y.node", F.struct(_apart(FOLDED).alias("apart"), F.xxhash64("x.node", "y.node").alias("drawn"))).alias("b"))


def _all_pairs(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of nodes of different groups that share so many keys that they may be similar,
    with their whole signatures to tell most others apart."""
    whole = rows.select(F.col("fp").alias("node"), *(F.col("signs")[k].alias(f"s{k}") for k in range(SIGNS)))
    placed = materialize(placed.drop(*(f"s{k}" for k in range(FOLDED))).join(whole.distinct(), "node"))
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (
        F.col("x.root") != F.col("y.root"))
    pairs = placed.alias("x").join(placed.alias("y"), differ & _possible(SIGNS)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), "x.key",
        (F.col("x.n") + F.col("y.n")).alias("total"), F.greatest("x.n", "y.n").alias("n"))
    # common shingles that are no common keys come after the keys of the text whose keys end first
    after = F.ceil(F.col("n") * ALIKE / OF) - 1
    return (pairs.groupBy("a", "b", "total", "n").agg(F.count_distinct("key").alias("c"))
            .where((F.col("c") + after) * (ALIKE + OF) >= F.col("total") * ALIKE).select("a", "b"))


def _open(placed: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows under keys with several groups, how many pairs of different groups meet there, and how
    many rows they are."""
    groups = placed.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    keys = materialize(groups.groupBy("key").agg(
        F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("groups"))
        .where("groups > 1"))
    row = keys.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
    left = materialize(placed.join(keys.select("key"), "key", "left_semi"))
    release(keys)
    return left, int(row[0] or 0), int(row[1] or 0)


def links(docs: DataFrame, rows: DataFrame, *, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """(a, b): verified pairs of nodes that connect all nodes of the least similarity; `rows` is the
    table of ``_table``."""
    context = docs.sparkSession.sparkContext
    heads = materialize(
        rows.select(F.explode("keys").alias("key"), "fp").groupBy("key")
        .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key"))
    met = context.broadcast(_met(heads, "key"))
    shared = materialize(_postings(rows, met).distinct().join(heads, "key", "left_semi"))
    release(heads)

    def compared(pairs, seen):
        """The links among the pairs not seen before, and all pairs seen."""
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        new = materialize(new if seen is None else new.join(seen, ["a", "b"], "left_anti"))
        return _verified(docs, rows, new, text_col, shingle), new if seen is None else seen.union(new)

    def regrouped(postings, found):
        """The open rows with the groups that the links make."""
        named = postings.drop("root").join(components(found), "node", "left")
        left, pairs, size = _open(named.withColumn("root", F.coalesce("root", "node")))
        release(postings)
        return left, pairs, size

    near, seen = compared(_print_pairs(rows), None)
    left, pairs, size = regrouped(shared, near)
    turn = 0
    while pairs > FEW * size:
        before = seen.count()
        found, seen = compared(_star_pairs(left, turn), seen)
        links_ = found.count()
        if links_:
            near = near.union(found)
            left, pairs, size = regrouped(left, near)
        if links_ < SHARE * (seen.count() - before):
            break
        turn += 1
    return near.union(compared(_all_pairs(left, rows), seen)[0]) if pairs else near


def near_copy_groups(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, text_key, fp, component_id, first_key) of every row, as ``simhash_groups`` names them;
    fp is the hash of the set of shingles.

    Null and wordless texts have the empty set and are one group; a text of fewer than five words is
    one shingle. Ids may be null (they name a group only if all its ids are null) or repeated; rows equal in
    id and text stay rows here. Other columns are not read; an empty table gives no rows. A chunk of
    texts takes some 40 bytes of memory a byte, so a text of 16 MB takes some 600 MB."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    with text_batches(docs.sparkSession):
        common = docs.sparkSession.sparkContext.broadcast(_commonness(texts, shingle))
        rows = materialize(_table(docs, common, id_col, text_col, shingle))
        found = links(docs, rows, shingle=shingle, text_col=text_col)
    return named_groups(rows.select("id", "text_key", "fp"), found, id_col)


def keep_first(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents with one row of each group left, the one with the smallest id (of equal ids, the
    one whose text has the smallest hash); rows repeated in id and text are one document. All other
    cases are those of ``near_copy_groups``."""
    groups = near_copy_groups(docs, shingle=shingle, id_col=id_col, text_col=text_col)
    return leave_first(docs, groups, id_col=id_col, text_col=text_col)
