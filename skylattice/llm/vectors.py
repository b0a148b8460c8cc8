"""Embedding near-duplicates by product quantisation.

Unit vectors go into coarse inverted lists; their residuals are coded per subspace. Every vector
probes its nearest lists: table look-ups give the distance to each coded member, members that their
own coding error could bring within reach are compared exactly in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.components import components
from skylattice.session import materialize

#: Rows the centroids and codebooks are fitted on; every row is indexed.
TRAIN_ROWS = 16384
SUBSPACES = 8
CODES = 256
#: Lists each vector looks into.
PROBES = 12
#: Most members and most probing vectors that one task compares at a time.
MEMBERS, ASKERS = 2048, 8192


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=k)
        filled = size > 0
        centers[filled] = sums[filled] / size[filled, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centers of each row, the nearest first."""
    n = min(n, len(centers))
    out = np.empty((len(x), n), np.int64)
    half = (centers * centers).sum(axis=1) / 2
    for a in range(0, len(x), 1024):
        far = half - x[a:a + 1024] @ centers.T
        best = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(
            np.arange(n), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable")
        out[a:a + 1024] = np.take_along_axis(best, order, 1)
    return out


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Coarse centers and one codebook per subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = sample.astype(np.float32)
        self.dims = x.shape[1]
        self.width = -(-self.dims // SUBSPACES)
        self.centers = _kmeans(x, max(1, min(lists, len(x))))
        rest = self.padded(x - self.centers[_nearest(x, self.centers, 1)[:, 0]])
        self.books = [
            _kmeans(np.ascontiguousarray(rest[:, s]), min(CODES, len(x))) for s in range(SUBSPACES)]

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SUBSPACES * self.width), np.float32)
        out[:, :self.dims] = x
        return out.reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each vector and what its codes stand for."""
        rest = self.padded(x - self.centers[lists])
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, s]), book, 1)[:, 0]
                          for s, book in enumerate(self.books)], axis=1).astype(np.uint8)
        coded = np.stack([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - coded) ** 2).sum(axis=(1, 2)))

    def distances(self, x: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from each vector to each coded member of a list, by table look-up."""
        rest = self.padded(x - self.centers[list_no])
        far = np.zeros((len(x), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            part = rest[:, s]
            table = ((part * part).sum(axis=1)[:, None] - 2 * part @ book.T
                     + (book * book).sum(axis=1))
            far += table[:, codes[:, s]]
        return far


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): the components as packed doubles; null unless all are finite and one is not 0."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def packed(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                if values is None or len(values) == 0 or values.null_count:
                    out.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return vectors.select(id_col, vec_col).mapInArrow(packed, f"id {id_type}, vec binary")


def _near_pairs(reps: DataFrame, least: float, probes: int) -> DataFrame:
    """(a, b) with a < b: pairs of representatives of one length with cosine >= least."""
    spark, total = reps.sparkSession, reps.count()
    sample = reps.orderBy(F.xxhash64("vec"), "vec").limit(TRAIN_ROWS).select("vec").toPandas()["vec"]
    lists = max(1, min(round(math.sqrt(total)), len(sample) // 4))
    shared = spark.sparkContext.broadcast(Quantiser(_units(list(sample)), lists))
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def encoded(batches):
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(1).to_pylist()).astype(np.float32)
            near = _nearest(x, q.centers, probes)
            codes, error = q.encode(x, near[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near[:, 0].astype(np.int32)),
                 pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(error.astype(np.float32)),
                 pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                names=["rep", "vec", "list", "code", "error", "probes"])

    table = materialize(reps.select("rep", "vec").mapInArrow(
        encoded, "rep long, vec binary, list int, code binary, error float, probes array<int>"))
    asking = table.select(F.col("rep").alias("asker"), F.col("vec").alias("asked"),
                          F.explode("probes").alias("list"))
    # one row per list, so bounded by the training rows: how many blocks it is cut into
    cuts = F.broadcast(
        table.groupBy("list").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        .join(asking.groupBy("list").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("turns")),
              "list"))

    def cut(df, name, own, n_own, other, n_other):
        return (df.join(cuts, "list")
                .withColumn(own, F.pmod(F.xxhash64(name), F.col(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
                .drop("blocks", "turns"))

    members = cut(table.drop("probes"), "rep", "block", "blocks", "turn", "turns")
    askers = cut(asking, "asker", "turn", "turns", "block", "blocks")
    key = ["list", "block", "turn"]

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            q = shared.value
            number = left["list"][0].as_py()
            member, asker = left["rep"].to_numpy(), right["asker"].to_numpy()
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            limit = (reach + left["error"].to_numpy() + 1e-4) ** 2
            exact, ask = _units(left["vec"].to_pylist()), _units(right["asked"].to_pylist())
            for a in range(0, len(ask), 256):
                far = q.distances(ask[a:a + 256].astype(np.float32), number, codes)
                i, j = np.nonzero(far <= limit)
                i += a
                other = asker[i] != member[j]
                i, j = i[other], j[other]
                for at in range(0, len(i), 16384):
                    x, y = i[at:at + 16384], j[at:at + 16384]
                    linked = np.einsum("ij,ij->i", ask[x], exact[y]) >= least
                    found_a.append(asker[x[linked]])
                    found_b.append(member[y[linked]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = members.groupBy(*key).cogroup(askers.groupBy(*key)).applyInArrow(compared, "a long, b long")
    return met.distinct()


def near_vectors(vectors: DataFrame, *, least: float = 0.9, probes: int = PROBES,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are one representative, compared once and counted as often as they occur; only
    vectors of one length are compared. Vectors that are null, empty, zero, or hold a null or
    non-finite component have no links and are their own component. Each list is compared in
    blocks of bounded size however many vectors it holds. What may be missed is a pair neither of
    which probes the other's list; the coding loses nothing, as its error widens the limit."""
    rows = materialize(usable_vectors(vectors, id_col, vec_col))
    reps = materialize(
        rows.where("vec IS NOT NULL").groupBy("vec")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("rep"), "vec", "first", "n"))
    pairs = None
    for length in [r[0] for r in reps.select(F.length("vec")).distinct().collect()]:
        found = _near_pairs(reps.where(F.length("vec") == length), least, probes)
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        pairs = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = materialize(pairs)
    sizes = reps.select("rep", "n")
    ways = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (ways.join(sizes, ways["b"] == sizes["rep"]).groupBy("a").agg(F.sum("n").alias("others")))
    rooted = components(pairs)
    labelled = reps.join(rooted, reps["rep"] == rooted["node"], "left").select(
        "rep", "vec", "first", "n", F.coalesce("root", "rep").alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = materialize(
        labelled.join(named, "root").join(linked, labelled["rep"] == linked["a"], "left")
        .select("vec", "component_id",
                (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    found = rows.join(facts, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
