"""Mixing sources to target weights: random order within each source, cut at an exact budget.

DataFrame operations only. A document's place within its source is the order of a hash of its id;
the sum of words before it is a running sum inside a slice of the hash range plus the sum of the
slices before, so no source is ever sorted or summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.llm.frames import fresh, own, quoted
from skylattice.session import materialize

#: Slices of the hash range; a source of 10^10 documents has about 2.4 million in each.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Longest runs of bytes that are no ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source_key, source, source_size): shares of the total by the weights,
    dealt to the sources by code point with null last, none above ``max_epochs`` times its size.

    The excess of full sources is shared again by weight until none is above: min(cap, level x
    weight) with the level at which the targets add up. Windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    dealt = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("fill", F.col("source").isNull(), "source")
    steps = (
        dealt.withColumn("fill", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(
            F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(
        Window.partitionBy())["level"]
    return steps.withColumn("level", level).select(
        "source_key", "source", "source_size",
        F.round(F.least(cap, F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")), 6)
        .alias("target"))


def mix_sources(docs: DataFrame, *, weights: list[int], max_epochs: int = 3,
                id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, copies) of every row.

    ``size`` counts words. A source's budget is its target rounded; it is used up by as many full
    epochs as fit and then by documents in hash order, the last one in part. ``taken`` is the
    words taken, ``copies`` the number of times a document is begun. Equal ids are ordered by size,
    equal rows are interchangeable; a null id comes first. Empty documents take nothing, and have
    a copy in each full epoch. An empty table has an empty result."""
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    first = F.coalesce(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), F.lit(0))
    sized = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), key.alias("key"),
        F.floor(first * SLICES / 65536).cast("int").alias("slice"),
        F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("source_key")))
    slices = sized.groupBy("source_key", "source", "slice").agg(F.sum("size").alias("words"))
    sources = slices.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    earlier = (Window.partitionBy("source_key").orderBy("slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor(F.col("target") + 0.5)
    plan = (
        slices.withColumn("before_slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .select("source_key", "slice", "before_slice")
        .join(source_targets(sources, weights, max_epochs).drop("source"), "source_key")
        .withColumn("epochs", F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))),
                                         F.lit(0)))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    inside = (Window.partitionBy("source_key", "slice").orderBy("key", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("before_slice") + F.coalesce(F.col("before_row"), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return (
        sized.withColumn("before_row", F.sum("size").over(inside))
        .join(plan, ["source_key", "slice"])
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                "source_size", "target",
                (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
                (F.col("epochs") + F.when(part > 0, 1).otherwise(0)).cast("int").alias("copies"))
    )


def repeat_by_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", **options) -> DataFrame:
    """The documents in their own columns, each as many times as the mix begins it.

    Rows meet their copies by (id, source, size); rows equal in all three are dealt their copies
    in any order, by number. Texts are shuffled once, by id; rows repeated under one id meet in one
    task."""
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = materialize(mixed.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                                      F.col("size").alias("_size"), F.col("copies").alias("_copies")))
    same = ["_id", "_source", "_size"]
    turn = fresh(docs, "turn")
    if not copies.groupBy(*same).count().where("count > 1").limit(1).count():
        rows, copies = docs.withColumn(turn, F.lit(1)), copies.withColumn("_turn", F.lit(1))
    else:
        size = word_count(F.col(text_col))
        rows = docs.withColumn(turn, F.row_number().over(
            Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_col))))
        copies = copies.withColumn("_turn", F.row_number().over(
            Window.partitionBy(*same).orderBy(F.desc("_copies"))))
    copies = copies.where("_copies > 0")
    match = (rows[id_col].eqNullSafe(copies["_id"]) & rows[source_col].eqNullSafe(copies["_source"])
             & (word_count(rows[text_col]) == copies["_size"]) & (rows[turn] == copies["_turn"]))
    again = F.array_repeat(F.lit(1), copies["_copies"])
    taken = rows.join(copies, match).select(
        *[rows[quoted(c)] for c in docs.columns], again.alias(turn))
    return taken.withColumn(turn, F.explode(turn)).select(*own(docs))
