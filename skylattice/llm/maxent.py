"""Language-model scores from a hashed maximum-entropy model.

Words fall into nested classes by a hash of their ending. The model predicts the class, the class
inside it and so on, each by a softmax over the sum of the weight rows of hashed features: the
previous word, the word before it (a skip), and the two together. Inside the last class, words
share its mass by their corpus counts, which are exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.buffers import chunks, flat, lower, mixed, spans, word_hashes
from skylattice.session import materialize

#: Each level of the class tree has so many branches; its leaves are the members.
WIDTH, LEVELS = 16, 3
LEAVES = WIDTH ** LEVELS
#: Hashed weight rows of each feature at each level, as powers of two.
ROW_BITS = (12, 13, 14)
FEATURES = 3
#: Bytes at the end of a word that decide its bucket.
ENDING = 3
BATCH = 32768
RATE = 0.2
#: Weight rows that travel together when the tasks' updates are added up.
SLICE = 1024
#: Updates added up in one group.
FAN_IN = 32
#: Words with at least one in so many of the training tokens are looked up from memory, so there
#: are at most so many of them; all others are joined.
HEAD_SHARE = 1 << 19
#: The token that ends a text. No word has a blank.
END = b" "
_END_HASH = np.uint64(0x1D8E4E27C47D124F)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Last class of each word: a hash of its last bytes. The end token has class 0 to itself."""
    key = np.zeros(len(starts), np.uint64)
    for back in range(1, ENDING + 1):
        inside = ends - back >= starts
        at = np.where(inside, ends - back, 0)
        key = key * np.uint64(257) + np.where(inside, low[at], 0).astype(np.uint64)
    return (mixed(key * _SALTS[0] + np.uint64(1)) % np.uint64(LEAVES - 1)).astype(np.int64) + 1


def sequence(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, word hash, bucket) of every token in order, each text closed by the end token."""
    starts, ends, rows = spans(low, offsets)
    n, texts = len(starts), len(offsets) - 1
    words = np.bincount(rows, minlength=texts)
    at = np.arange(n) + rows
    row = np.repeat(np.arange(texts), words + 1)
    hashes = np.full(n + texts, _END_HASH, np.uint64)
    bucket = np.zeros(n + texts, np.int64)
    if n:
        hashes[at] = word_hashes(low, starts, ends)
        bucket[at] = buckets(low, starts, ends)
    return row, hashes, bucket


def contexts(row: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """One 32-bit hash per token and feature; places before a text hold the end token."""
    before = np.full((2, len(row)), _END_HASH, np.uint64)
    for k in (1, 2):
        inside = row[k:] == row[:-k]
        before[k - 1, k:][inside] = hashes[:-k][inside]
    both = before[0] * _SALTS[1] + before[1]
    return [(mixed(x + salt) >> np.uint64(32)).astype(np.uint32)
            for x, salt in zip((before[0], before[1], both), _SALTS)]


class Model:
    """Weight tables of the levels; biases are the logarithms of the smoothed bucket counts."""

    def __init__(self, counts: np.ndarray, kinds: np.ndarray):
        mass = counts + kinds + 1.0
        self.inside = np.log10(mass)  # divides a word's count + 1
        self.bias, self.weights = [], []
        for level in range(LEVELS):
            below = mass.reshape(WIDTH ** level, WIDTH, -1).sum(axis=2)
            self.bias.append(np.log(below / below.sum(axis=1, keepdims=True)).astype(np.float32))
            self.weights.append(np.zeros((FEATURES << ROW_BITS[level], WIDTH), np.float32))

    def _levels(self, context: list[np.ndarray], bucket: np.ndarray):
        """Per level: its number, the weight rows of each feature, the biases, the branch taken."""
        for level in range(LEVELS):
            node = bucket // WIDTH ** (LEVELS - level)
            turn = node.astype(np.uint32) * np.uint32(0x85EBCA6B)
            shift = np.uint32(32 - ROW_BITS[level])
            rows = [((c + turn) * np.uint32(0x9E3779B1) >> shift).astype(np.int64)
                    + (f << ROW_BITS[level]) for f, c in enumerate(context)]
            bias = np.take(self.bias[level], node, axis=0)
            yield level, rows, bias, bucket // WIDTH ** (LEVELS - level - 1) % WIDTH

    def _softmax(self, level: int, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        logits = bias
        for r in rows:
            logits += np.take(self.weights[level], r, axis=0)
        np.exp(logits, out=logits)  # biases are at most 0 and weights are clipped
        logits /= (logits @ np.ones(WIDTH, np.float32))[:, None]
        return logits

    def log10(self, context: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
        """log10 probability of each token's last class."""
        out = np.empty(len(bucket))
        for a in range(0, len(bucket), BATCH):
            part, one = [c[a:a + BATCH] for c in context], 1.0
            for level, rows, bias, truth in self._levels(part, bucket[a:a + BATCH]):
                one = one * self._softmax(level, rows, bias)[np.arange(len(truth)), truth]
            out[a:a + BATCH] = np.log10(np.maximum(one, 1e-30))
        return out

    def learn(self, context: list[np.ndarray], bucket: np.ndarray, seen: list[np.ndarray],
              squares: list[np.ndarray]) -> None:
        """Gradient steps over the tokens in batches, each weight's step scaled by the root of its
        summed squared gradients; `seen` counts the uses of each weight row."""
        for a in range(0, len(bucket), BATCH):
            part = [c[a:a + BATCH] for c in context]
            for level, rows, bias, truth in self._levels(part, bucket[a:a + BATCH]):
                table, uses, past = self.weights[level], seen[level], squares[level]
                pull = self._softmax(level, rows, bias)
                pull[np.arange(len(truth)), truth] -= 1
                across = np.ascontiguousarray(pull.T)
                size = 1 << ROW_BITS[level]
                for f, r in enumerate(rows):
                    own, r = slice(f * size, (f + 1) * size), r - f * size
                    sums = np.empty((size, WIDTH), np.float32)
                    for k in range(WIDTH):
                        sums[:, k] = np.bincount(r, weights=across[k], minlength=size)
                    uses[own] += np.bincount(r, minlength=size)
                    past[own] += sums * sums
                    table[own] -= RATE * sums / np.sqrt(past[own] + 1e-6)
                np.clip(table, -8, 8, out=table)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all texts, the end token included; summed in each task before the shuffle."""

    def counted(batches):
        for batch in batches:
            seen = Counter()
            for text in batch.column(0):
                seen.update((text.as_py() or b"").lower().split())
            seen[END] += batch.num_rows
            words = list(seen)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())],
                    names=["word", "c"])

    raw = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(
        counted, "word binary, c long")
    return materialize(raw.groupBy("word").agg(F.sum("c").alias("c")))


def bucket_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each bucket."""

    def summed(batches):
        for batch in batches:
            low, offsets = flat(batch.column(0))
            at = buckets(low, offsets[:-1], offsets[1:])
            at[[i for i, w in enumerate(batch.column(0).to_pylist()) if w == END]] = 0
            c = np.bincount(at, weights=batch.column(1).to_numpy(), minlength=LEAVES)
            kinds = np.bincount(at, minlength=LEAVES)
            met = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(met), pa.array(c[met].astype(np.int64)), pa.array(kinds[met])],
                names=["bucket", "c", "kinds"])

    parts = counts.mapInArrow(summed, "bucket long, c long, kinds long")
    tokens, kinds = np.zeros(LEAVES), np.zeros(LEAVES)
    for row in parts.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("kinds").alias("k")).collect():
        tokens[row["bucket"]], kinds[row["bucket"]] = row["c"], row["k"]
    return tokens, kinds


def _updates(shared, text_batches):
    """One task's pass over its texts: per slice, the uses of its rows and their weighted change."""
    start = shared.value
    model = Model.__new__(Model)
    model.inside, model.bias = start.inside, start.bias
    model.weights = [w.copy() for w in start.weights]
    seen = [np.zeros(len(w), np.float32) for w in model.weights]
    squares = [np.zeros_like(w) for w in model.weights]
    for batch in text_batches:
        data, offsets = flat(batch.column(0))
        for _, _, part, ends in chunks(data, offsets):
            row, hashes, bucket = sequence(lower(part), ends)
            model.learn(contexts(row, hashes), bucket, seen, squares)
    slices, blobs = [], []
    for level, (new, old, uses) in enumerate(zip(model.weights, start.weights, seen)):
        for a in range(0, len(new), SLICE):
            n = uses[a:a + SLICE]
            if n.any():
                change = (new[a:a + SLICE] - old[a:a + SLICE]) * n[:, None]
                slices.append(level * 1000 + a // SLICE)
                blobs.append(np.column_stack([n, change]).astype(np.float32).tobytes())
    if slices:
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())],
                                         names=["slice", "blob"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE * (WIDTH + 1), np.float64)
    for blob in table["blob"]:
        total += np.frombuffer(blob.as_py(), np.float32)
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()),
                     "slice": pa.array([table["slice"][0].as_py()], pa.int32()),
                     "blob": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, model: Model, text_col: str) -> Model:
    """One round of distributed gradient updates: every task takes its steps over all its texts from
    the common start, and a row's changes are averaged by how often each task used the row. The
    updates have the size of the model and are added up in a tree."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    updates = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(
        lambda batches: _updates(shared, batches), "slice int, blob binary")
    updates = updates.withColumn("part", F.spark_partition_id())
    for step in range(3):
        part = (F.col("part") / FAN_IN).cast("int") if step < 2 else F.lit(0)
        updates = (updates.withColumn("part", part).groupBy("slice", "part")
                   .applyInArrow(_add, "part int, slice int, blob binary"))
    for row in updates.select("slice", "blob").toLocalIterator():
        total = np.frombuffer(row["blob"], np.float32).reshape(SLICE, WIDTH + 1)
        level, a = row["slice"] // 1000, row["slice"] % 1000 * SLICE
        model.weights[level][a:a + SLICE] += total[:, 1:] / np.maximum(total[:, :1], 1)
    return model


def score_texts(docs: DataFrame, *, training: Column, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model and the counts come from all training rows. A null text counts as empty and has the
    end token alone. Frequent words, of which HEAD_SHARE bounds the number, are looked up in memory;
    all others are joined with the counts, and none of those is frequent in the training rows.
    Without training rows every token is unknown and base_score is 0."""
    spark = docs.sparkSession
    learn = docs.where(training)
    counts = word_counts(learn, text_col)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = int(total[0]), int(total[1])
    model = train(learn, Model(*bucket_counts(counts)), text_col)
    frequent = F.col("c") * HEAD_SHARE >= tokens
    head = {bytes(r[0]): math.log10(r[1] + 1) for r in counts.where(frequent).collect()}
    shared = spark.sparkContext.broadcast((model, head))
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        m, known = shared.value
        end = known.get(END)
        for batch in batches:
            data, offsets = flat(batch.column(2))
            likely, spread = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int64)
            for a, b, part, ends in chunks(data, offsets):
                row, hashes, bucket = sequence(lower(part), ends)
                size[a:b] = np.bincount(row, minlength=b - a)
                likely[a:b] = np.bincount(row, m.log10(contexts(row, hashes), bucket), b - a)
                spread[a:b] = np.bincount(row, m.inside[bucket], b - a)
            sums, met, tails = [], [], []
            for text in batch.column(2):
                words = (text.as_py() or b"").lower().split()
                found = [known.get(w) for w in words]
                tails.append([w for w, v in zip(words, found) if v is None])
                if end is None:
                    tails[-1].append(END)
                values = [v for v in found if v is not None]
                sums.append(math.fsum(values) + (end or 0.0))
                met.append(len(values) + (end is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(likely - spread),
                 pa.array(sums, pa.float64()), pa.array(met, pa.int64()),
                 pa.array(tails, pa.list_(pa.binary()))],
                names=["row", "id", "n_tokens", "likely", "head", "met", "tail"])

    rows = materialize(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                    F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(scored, f"row long, id {id_type}, n_tokens long, likely double, head double, "
                            "met long, tail array<binary>"))
    rare = rows.select("row", F.explode("tail").alias("word")).join(
        counts.where(~frequent), "word")
    rest = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"),
                                   F.count("*").alias("also"))
    whole = rows.drop("tail").join(rest, "row", "left")
    plain = F.col("head") + F.coalesce("more", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("met") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (plain - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"),
        (plain + F.col("likely")).alias("score"))
