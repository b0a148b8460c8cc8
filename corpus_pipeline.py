"""The corpus pipeline: language, near-duplicates, benchmark leaks, mixing, shards.

Each stage reads what the one before it wrote and takes (spark, docs, sf_dir); all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.llm import copies, decontaminate, language, mixing, ring
from skylattice.llm.catalog import MIX_WEIGHTS, id_crc
from skylattice.llm.frames import own
from skylattice.session import ensure_checkpoint_dir, remove_folder, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: `und`, or two languages level."""
    model = language.fit_languages(docs, training=id_crc() % 4 != 2)
    found = language.identify(docs, model)
    kept = (F.col("lang_pred") != language.UNKNOWN) & ~F.col("lang_ambiguous")
    return found.where(kept).select(*own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of each group of near copies: five-word shingles,
    Jaccard similarity of 0.8 or more. Operator 8 gives the first candidates, an index the others."""
    return copies.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix begins them: not at all, once, or in several epochs."""
    return mixing.repeat_by_mix(docs, weights=MIX_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return ring.shard_documents(docs, 40)


STAGES = [
    ("language", identify_language),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mix", mix),
    ("shards", shard),
]

#: The stages learn classifiers and hash with XXH64, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read by the next. A stage's
    inner tables go when its output is written, and the output when the next one has read it."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if read:
            remove_folder(spark, read)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
