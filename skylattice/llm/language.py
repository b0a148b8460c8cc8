"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one linear classifier per bit reads hashed byte n-grams, and
the language whose codeword loses least, weighted by the margins, wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skylattice.llm.buffers import chunks, flat
from skylattice.llm.frames import quoted

DIMS = 4096
#: Rows the classifiers are fitted on, shared evenly among the languages.
SAMPLE_ROWS = 4000
UNKNOWN = "und"
#: A winner whose lead over the second language is below this is flagged as ambiguous.
LEAD = 0.05

_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 256)
for _c in range(26):
    _LETTER[[0x41 + _c, 0x61 + _c]] = 0x61 + _c


def codebook(languages: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all splits of few languages, else the random
    code (10 bits per doubling) with the largest least distance of many draws."""
    if languages <= 1:
        return np.ones((languages, 1), np.float32)
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        code = [[1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for s in splits]
                for k in range(languages)]
        return np.array(code, np.float32)
    rng = np.random.default_rng(seed)
    bits, best, widest = math.ceil(10 * math.log2(languages)), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(languages, dtype=bool)].min()
        if least > widest:
            best, widest = code, least
    return best


def features(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Unit rows of square-rooted counts of hashed byte 1-, 2- and 3-grams of letters; every run of
    other characters counts as blanks, and grams of blanks alone are left out."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint8)  # two blanks before each row
    at = np.repeat(2 * np.arange(1, n + 1), lengths) + np.arange(len(data))
    padded[at] = _LETTER[data]
    row = np.repeat(np.arange(n, dtype=np.int64) * dims, lengths + 2)
    wide = padded.astype(np.uint32)
    counts = np.zeros(n * dims, np.float32)
    shift = np.uint32(32 - int(math.log2(dims)))
    gram, blank = np.zeros(len(row), np.uint32), 0
    for size in range(3):
        gram = gram * np.uint32(65599) + wide[size: size + len(row)] + np.uint32(1)
        blank = (blank * 65599 + 33) & 0xFFFFFFFF
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(2654435761)
        part = np.bincount(row + (mixed >> shift), minlength=n * dims).astype(np.float32)
        empty = ((blank ^ (blank >> 15)) * 2654435761 & 0xFFFFFFFF) >> int(shift)
        part.reshape(n, dims)[:, empty] = 0
        counts += part
    table = np.sqrt(counts.reshape(n, dims))
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def fit_bits(x: np.ndarray, bits: np.ndarray, steps: int = 150, rate: float = 0.5,
             decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once, by Adam on the whole sample."""
    w = np.zeros((x.shape[1], bits.shape[1]), np.float32)
    b = np.zeros(bits.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        pull = -bits / (1 + np.exp(np.clip(bits * (x @ w + b), -30, 30))) / len(x)
        for value, grad, k in ((w, x.T @ pull + decay * w, 0), (b, pull.sum(axis=0), 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad * grad
            value -= (rate * (moments[k] / (1 - 0.9 ** step))
                      / (np.sqrt(moments[k + 1] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Probability of each language from the loss of its codeword, summed over the bits."""
    agree = np.clip(margins[:, None, :] * code[None], -30, 30)
    loss = np.log1p(np.exp(-agree)).sum(axis=2)
    weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return weight / weight.sum(axis=1, keepdims=True)


def _has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: an ASCII letter, else any character that Unicode calls a letter."""
    found = np.zeros(len(offsets) - 1, bool)
    for a, b, part, ends in chunks(data, offsets):
        letters = np.flatnonzero((_LETTER[part] != 32) & (part < 0x80))
        found[a:b] = np.diff(np.searchsorted(letters, ends)) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


def fit_languages(docs: DataFrame, *, training: Column, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang",
                  sample_rows: int = SAMPLE_ROWS) -> dict:
    """Languages, codewords and bit classifiers learned from the training rows with a language.

    The sample takes the first rows of each language by a hash of the id, then by id and text hash,
    `sample_rows` in all however often an id occurs; rows equal in id and text take up places, but
    are learned once. One scan counts
    the languages, one picks rows of all languages at once (every task keeps only its first rows), and
    one fetches their texts. Null languages and texts teach nothing."""
    known = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages = docs.where(training & F.col(lang_col).isNotNull()).select(lang_col).distinct().count()
    each = max(1, sample_rows // max(1, languages))
    keyed = known.withColumn("key", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "key")
    picks = (keyed.select("lang", "id", "key").withColumn("rank", F.row_number().over(order))
             .where(F.col("rank") <= each).select(
                 F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.col("key").alias("_key")).distinct())
    picked = (keyed.join(F.broadcast(picks), (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id"))
                         & (F.col("key") == F.col("_key")), "left_semi")
              .groupBy("lang", "id", "key").agg(F.first("text").alias("text")))

    def rows(batches):
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b, part, ends in chunks(data, offsets, most=256):
                x = features(part, ends).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a),
                     batch.column(2).slice(a, b - a)], names=["x", "lang", "h"])

    sample = (picked.select("text", "lang", F.col("key").alias("h"))
              .mapInArrow(rows, "x binary, lang string, h long").toPandas())
    names = sorted(sample["lang"].unique())
    if not names:
        return {"names": [], "code": codebook(0), "w": None, "b": None}
    sample = sample.sort_values(["lang", "h"], kind="stable")
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(-1, DIMS).astype(np.float32)
    code = codebook(len(names))
    truth = np.searchsorted(np.array(names, object), sample["lang"].to_numpy(object))
    w, b = fit_bits(x, code[truth])
    return {"names": names, "code": code, "w": w, "b": b}


def identify(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """Every row with its columns (but those of the same names) and ``lang_pred``, ``lang_score``
    (0 to 1) and ``lang_ambiguous``. A null text, or one without a letter, is `und` with score 0,
    as is everything when no language was learned. The model is a few hundred kilobytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    kept = [c for c in docs.columns if c.lower() not in added]
    plain = docs.select(*[quoted(c) for c in kept])
    numbered = plain.toDF(*[f"c{i}" for i in range(len(kept))])  # any name may come in
    at = kept.index(text_col)

    def predicted(batches):
        m = shared.value
        names = np.array([*m["names"], UNKNOWN], object)
        for batch in batches:
            texts = batch.column(at)
            data, offsets = flat(texts)
            best = np.full(batch.num_rows, len(names) - 1)
            score, lead = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            if m["names"]:
                for a, b, part, ends in chunks(data, offsets, most=256):
                    p = decode(features(part, ends) @ m["w"] + m["b"], m["code"])
                    best[a:b] = p.argmax(axis=1)
                    ranked = np.sort(p, axis=1)
                    score[a:b] = ranked[:, -1]
                    lead[a:b] = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
            none = ~_has_letter(texts, data, offsets)
            best[none], score[none] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score),
                 pa.array((lead < LEAD) & (best < len(names) - 1))],
                names=[*kept, *added])

    schema = T.StructType([
        *plain.schema.fields, T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])
    return numbered.mapInArrow(predicted, schema)
