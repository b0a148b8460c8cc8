"""Benchmark decontamination over a distributed positional inverted index.

DataFrame operations only. The index stores one posting (document, position, term) for every word
that the benchmark uses at all. A window of benchmark words is looked up from its rarest term: that
term's postings, shifted by its place in the window, are the candidate starts; they are intersected
with the shifted postings of the second rarest term, and what is left with those of all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylattice.session import materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tables of at most this many rows (two longs each) are broadcast, longer ones shuffled.
BROADCAST_ROWS = 500_000
#: Posting of a document's end; no word has this number. Its position is the number of words.
END = 0


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none in a null. Only texts with other than ASCII
    characters need the slower character table, so that no other letter changes."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def _sized(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table counted as small, else the table as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrase_windows(items: DataFrame, size: int, *, id_col: str = "item_id",
                   text_col: str = "text") -> DataFrame:
    """(window, k, words, items): every different run of ``size`` words, or all words of a shorter
    item, with the ids of the items it is from. Items without words have none."""
    listed = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    listed = listed.where(F.size("w") > 0)
    last = F.greatest(F.size("w") - F.lit(size), F.lit(0))
    runs = listed.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(
        "item", F.slice("w", F.col("at") + 1, F.lit(size)).alias("words"))
    table = runs.groupBy("words").agg(F.collect_set("item").alias("items"))
    return materialize(table.select(F.monotonically_increasing_id().alias("window"),
                                    F.size("words").alias("k"), "words", "items"))


def vocabulary(windows: DataFrame) -> DataFrame:
    """(word, term) for the words of the windows, and the empty word that ends every document."""
    table = materialize(windows.select(F.explode("words").alias("word")).distinct().select(
        "word", (F.monotonically_increasing_id() + 1).alias("term")))
    end = table.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term"))
    return table.union(end)


def build_index(docs: DataFrame, vocab: DataFrame, *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Postings (row, doc_id, text_key, pos, term), a table that stays in scan order: nothing is
    shuffled for it while the vocabulary is small. Rows are numbered, so repeated ids stay apart."""
    text = F.col(text_col)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"), text.alias("text"))
    placed = numbered.select("row", "doc_id", "text_key", F.posexplode(
        F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    met = placed.join(_sized(vocab), "word")
    return materialize(met.select("row", "doc_id", "text_key", "pos", "term"))


def ranked_terms(windows: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """(window, k, off, term, place): the terms of each window that can occur, rarest first."""
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    known = materialize(vocab.join(counts, "term"))
    terms = (windows.select("window", "k", F.posexplode("words").alias("off", "word"))
             .join(_sized(known), "word"))
    by = Window.partitionBy("window")
    return materialize(
        terms.withColumn("met", F.count("*").over(by)).where("met = k")
        .withColumn("place", F.row_number().over(by.orderBy("n", "off")))
        .select("window", "k", "off", "term", "place"))


def _postings_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    return index.join(_sized(materialize(terms.select("term").distinct())), "term", "left_semi")


def _intersect(found: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Those (row, window, start) for which every given term of the window lies at its place."""
    wanted = terms.groupBy("window").agg(
        F.collect_list(F.struct("off", "term")).alias("rest"))
    asked = (found.join(_sized(materialize(wanted)), "window")
             .select("row", "window", "start", F.size("rest").alias("need"),
                     F.explode("rest").alias("t"))
             .select("row", "window", "start", "need", (F.col("start") + F.col("t.off")).alias("pos"),
                     F.col("t.term").alias("term")))
    met = asked.join(postings.select("row", "pos", "term"), ["row", "pos", "term"])
    return (met.groupBy("row", "window", "start").agg(F.count("*").alias("n"), F.max("need").alias("need"))
            .where("n = need").select("row", "window", "start"))


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, window, start): every place where all words of a window stand in its order."""
    first = _sized(terms.where("place = 1").select("window", "off", "term"))
    found = materialize(
        index.select("row", "pos", "term").join(first, "term")
        .select("row", "window", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0"))
    single = terms.where("k = 1 AND place = 1").select("window")
    place = ["row", "window", "start"]
    done = found.join(single, "window", "left_semi").select(*place)
    second = terms.where("place = 2")
    found = materialize(_intersect(found, second, _postings_of(index, second)))
    rest = terms.where("place > 2")
    double = terms.where("k = 2 AND place = 1").select("window")
    done = done.union(found.join(double, "window", "left_semi").select(*place))
    rows = _sized(materialize(found.select("row").distinct()))
    postings = index.join(rows, "row", "left_semi")
    return materialize(done.union(_intersect(found, rest, postings)))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(row, window, start): places where every word of a window lies at most ``slop`` positions
    from where it would stand, counted from the rarest word."""
    first = _sized(terms.where("place = 1").select("window", "off", "term"))
    found = (index.select("row", "pos", "term").join(first, "term")
             .select("row", "window", (F.col("pos") - F.col("off")).alias("start")))
    asked = found.join(_sized(terms.select("window", "k", "off", "term")), "window")
    width = F.lit(slop + 1)
    cell = F.floor((F.col("start") + F.col("off")) / width)
    asked = asked.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    near = index.select("row", "term", "pos", F.floor(F.col("pos") / width).alias("cell"))
    met = asked.join(near, ["row", "term", "cell"]).where(
        F.abs(F.col("pos") - F.col("start") - F.col("off")) <= slop)
    return (met.groupBy("row", "window", "start")
            .agg(F.countDistinct("off").alias("n"), F.max("k").alias("k"))
            .where("n = k").select("row", "window", "start"))


def contamination(docs: DataFrame, items: DataFrame, *, size: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) of every document row.

    n_hit counts the words inside any occurrence of a window, each once. A null or wordless text
    has no words and no hits; a null item id counts for hits but is not listed. Without items or
    documents the result is all clean or empty."""
    windows = phrase_windows(items, size, id_col=item_col, text_col=item_text_col)
    vocab = vocabulary(windows)
    index = build_index(docs, vocab, id_col=id_col, text_col=text_col)
    terms = ranked_terms(windows, vocab, index)
    matches = phrase_matches(index, terms)
    found = matches.join(_sized(windows.select("window", "k", "items")), "window")
    in_order = Window.partitionBy("row").orderBy("start", "k")
    covered = F.max(F.col("start") + F.col("k")).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.col("start") + F.col("k") - F.greatest(F.col("start"), F.coalesce(covered, F.lit(0)))
    hits = (found.select("row", F.greatest(gain, F.lit(0)).alias("gain"))
            .groupBy("row").agg(F.sum("gain").alias("n_hit")))
    listed = (found.select("row", "window", "items").dropDuplicates(["row", "window"])
              .select("row", F.explode("items").alias("item")).distinct()
              .groupBy("row").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("ids")))
    rows = index.where(F.col("term") == END).select("row", "doc_id", "text_key", "pos")
    none = F.array().cast("array<string>")
    judged = rows.join(hits.join(listed, "row", "left"), "row", "left")
    ids = F.coalesce("ids", none)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select(
        F.col("doc_id").alias(id_col), "text_key", F.col("pos").cast("long").alias("n_words"),
        n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, in their own columns."""
    judged = contamination(docs, items, id_col=id_col, text_col=text_col, **options)
    bad = materialize(judged.where("contaminated").select(
        F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).distinct())
    match = docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_key"])
    return docs.join(_sized(bad), match, "left_anti")
