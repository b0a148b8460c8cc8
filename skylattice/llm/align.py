"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

Both tokenizations tile the bytes of a blank and the text. All tokens of A and B are sorted by their
start, the running maximum of their ends is taken, and a group breaks where a start reaches it:
there tokens of both end together. Inside a group the overlapping pairs expand.

Texts that are null or empty, and texts whose tokens do not join to a blank and the text again, have no
tokens. Rows are numbered, so ids may be null or repeated; other columns are not read. A text is
tokenized as a whole: its tokens take some 100 bytes of memory for each byte of text, one text (or
one megabyte of shorter ones) at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylattice.llm.buffers import chunks, flat
from skylattice.session import materialize

MARK = "▁"
#: Most bytes of a vocabulary file; both are sent to every task.
MAX_FILE = 64 << 20
#: Tables of id pairs of at most this many rows (16 bytes each) are broadcast, longer ones shuffled.
BROADCAST_ROWS = 2_000_000
#: Units, and characters of units, whose tokens a task remembers.
MEMO_UNITS, MEMO_CHARS = 400_000, 8_000_000
#: A single blank between two characters that are certainly no white space: both vocabularies begin a
#: new token there, whatever stands on either side.
_CUT = re.compile("(?<=[!-~\u00c0-\u024f])(?= [!-~\u00c0-\u024f])")


class Tokens(NamedTuple):
    """Tokens of a run of texts, one after the other; byte positions go through the whole run."""
    a: np.ndarray  # ids
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_group: np.ndarray  # ascending, through the whole run
    b_group: np.ndarray
    a_of: np.ndarray  # bounds of each text's tokens
    b_of: np.ndarray
    base: np.ndarray  # first byte of each text


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is larger than a vocabulary that is sent to every task")
    with open(path, "rb") as file:
        return file.read()


def byte_characters() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers inside a task, with the bytes of every entry."""

    def __init__(self, tokenizer: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_str(tokenizer.decode())
        self.left.encode_special_tokens = True
        self.left.no_truncation()
        self.left.no_padding()
        self.right = sentencepiece.SentencePieceProcessor(model_proto=model)
        code, vocab = byte_characters(), self.left.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode()
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.right.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        split = json.loads(tokenizer).get("pre_tokenizer") or {}
        self.by_unit = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                        and not split.get("add_prefix_space")
                        and not any(MARK in p.lstrip(MARK) for p in pieces))
        self._forget()

    def _forget(self) -> None:
        """Units met so far: their numbers, the ids of all, one after the other, and whether they join
        to the unit again."""
        self.number: dict[str, int] = {}
        self.held = 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.of = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.zeros(0, bool)

    def _learn(self, units: list[str]) -> None:
        """Token ids of new units, as the libraries give them."""
        left = [x.ids for x in self.left.encode_batch_fast(units, add_special_tokens=False)]
        right = self.right.encode([u[1:] for u in units], num_threads=1)  # B puts the blank back
        for side, found in enumerate((left, right)):
            flat_ids = np.fromiter(chain.from_iterable(found), np.int32)
            self.ids[side] = np.concatenate([self.ids[side], flat_ids])
            sizes = np.cumsum([len(x) for x in found])
            self.of[side] = np.concatenate([self.of[side], self.of[side][-1] + sizes])
        a_text, b_text = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = [b"".join(map(a_text, a)) == u.encode() == b"".join(map(b_text, b))
                 for u, a, b in zip(units, left, right)]
        self.whole = np.concatenate([self.whole, np.array(whole, bool)])
        self.number.update(zip(units, range(len(self.number), len(self.whole))))
        self.held += sum(map(len, units))

    def tokens(self, texts: list[str | None]) -> Tokens:
        """Tokens of the texts and their groups; texts that have none are left empty. Texts are cut into
        units between single blanks, where both vocabularies begin a token, and only new units are
        tokenized; other vocabularies take whole texts."""
        if len(self.number) > MEMO_UNITS or self.held > MEMO_CHARS or not self.by_unit:
            self._forget()
        cut = _CUT.split if self.by_unit else (lambda t: [t])
        units = [cut(" " + t) if t else [] for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.number]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(u) for u in units])
        lost = np.bincount(text[~self.whole[at]], minlength=len(texts)) > 0
        at, text = at[~lost[text]], text[~lost[text]]

        def joined(side, size):
            start, count = self.of[side][at], np.diff(self.of[side])[at]
            ahead = np.cumsum(count) - count
            ids = self.ids[side][np.arange(count.sum()) + np.repeat(start - ahead, count)].astype(np.int64)
            each = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
            return ids, np.concatenate([[0], np.cumsum(each)]), np.cumsum(size[ids])

        a, a_of, a_end = joined(0, self.a_size)
        b, b_of, b_end = joined(1, self.b_size)
        group = coalesced(np.concatenate([a_end - self.a_size[a], b_end - self.b_size[b]]),
                          np.concatenate([a_end, b_end]))
        base = np.concatenate([[0], a_end])[a_of[:-1]]
        return Tokens(a, b, a_end, b_end, group[:len(a)], group[len(a):], a_of, b_of, base)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group of every interval, numbered from 0: intervals sorted by start belong together until a
    start reaches the maximum of all ends before it."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every A and B token that share a byte; both sides tile the same bytes."""
    a_start, b_start = (np.concatenate([[0], x])[:-1] for x in (a_end, b_end))
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.searchsorted(b_start, a_end, side="left") - first
    left = np.repeat(np.arange(len(a_end)), count)
    skip = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    return left, first[left] + skip


def _runs(batches, files) -> Iterator[tuple[Pair, pa.RecordBatch, int, Tokens]]:
    """Tokens of the last column's texts, run by run, with the columns before it."""
    pair = Pair(*files.value)
    for batch in batches:
        data, offsets = flat(batch.column(batch.num_columns - 1))
        for a, b, _, _ in chunks(data, offsets):
            part = batch.slice(a, b - a)
            yield pair, part, b - a, pair.tokens(part.column(part.num_columns - 1).to_pylist())


def _sent(docs: DataFrame, tokenizer_file: str, model_file: str):
    return docs.sparkSession.sparkContext.broadcast((_read(tokenizer_file), _read(model_file)))


def _last(group: np.ndarray) -> np.ndarray:
    """Positions of the last token of each group."""
    return np.flatnonzero(np.diff(group, append=group[-1:] + 1))


def _written(t: Tokens) -> tuple[memoryview, np.ndarray]:
    """Groups as text, `a1,a2|b1;a3|b2,b3;`, and the bounds of each document in it."""
    groups = len(_last(t.a_group))
    a_count, b_count = (np.bincount(g, minlength=groups) for g in (t.a_group, t.b_group))
    first = np.concatenate([[0], np.cumsum(a_count + b_count)])[:-1]
    a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
    at_a = first[t.a_group] + np.arange(len(t.a)) - a_first[t.a_group]
    at_b = (first + a_count)[t.b_group] + np.arange(len(t.b)) - b_first[t.b_group]
    ids, ending = np.empty(len(t.a) + len(t.b), np.int64), np.zeros(len(t.a) + len(t.b), np.int64)
    ids[at_a], ids[at_b] = t.a, t.b
    ending[at_a[_last(t.a_group)]], ending[at_b[_last(t.b_group)]] = 1, 2
    numbers, at = np.unique(ids, return_inverse=True)
    words = pa.array([b"%d%c" % (n, mark) for n in numbers.tolist() for mark in b",|;"], pa.large_binary())
    taken = words.take(pa.array(at * 3 + ending))
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64)[:len(ids) + 1]
    return memoryview(data), offsets[t.a_of + t.b_of]


def aligned(docs: DataFrame, tokenizer_file: str, model_file: str, *, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, groups_sha256, pairs, times) of every document. `pairs` are the
    different linked ids, a times the size of B's vocabulary plus b; tokens are linked where they end
    together, which is once in each group."""
    files = _sent(docs, tokenizer_file, model_file)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))

    def computed(batches):
        for pair, part, n, t in _runs(batches, files):
            sums = [""] * n
            linked, links = np.zeros(n, np.int64), np.zeros(0, np.int64)
            rows, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(t.a):
                text, bounds = _written(t)
                for i in np.flatnonzero(np.diff(bounds)):
                    sums[i] = hashlib.sha256(text[bounds[i]:bounds[i + 1] - 1]).hexdigest()
                ends = _last(t.a_group)
                of = np.searchsorted(t.a_of, ends, side="right") - 1
                linked = np.bincount(of, minlength=n)
                pairs = t.a[ends] * len(pair.b_bytes) + t.b[_last(t.b_group)]
                order = np.lexsort((pairs, of))
                of, pairs = of[order], pairs[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])
                rows, links = of[new], pairs[new]
                times = np.diff(np.flatnonzero(new), append=len(of))
            bounds = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(t.a_of)), pa.array(np.diff(t.b_of)),
                 pa.array(linked), pa.array(sums), pa.ListArray.from_arrays(bounds, pa.array(links)),
                 pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))],
                names=["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return narrow.mapInArrow(
        computed, f"row long, id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "pairs array<long>, times array<int>")


def link_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, top) over all documents; `top`: no pair with the same B id has a higher count."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = materialize(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")))
    b = F.pmod("pair", F.lit(b_size)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    if b_size <= BROADCAST_ROWS:
        most = F.broadcast(most)
    return materialize(counts.withColumn("b", b).join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("top")))


def alignment(docs: DataFrame, tokenizer_file: str, model_file: str, *, id_col: str = "doc_id",
              text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    count_sum adds up, over the document's links, how many links of the corpus hold the same two
    ids; n_best counts the links whose number is the highest of their B id. A document without
    tokens has zeros and an empty digest, an empty table no rows. The table of pairs is broadcast
    only if it has at most `broadcast_rows` rows, else joined by a shuffle."""
    import sentencepiece

    found = materialize(aligned(docs, tokenizer_file, model_file, id_col=id_col, text_col=text_col))
    b_size = sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()
    counts = link_counts(found, b_size)
    if counts.count() <= broadcast_rows:
        counts = F.broadcast(counts)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("n"))).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        none("n_best"), none("count_sum"), "groups_sha256")


def token_groups(docs: DataFrame, tokenizer_file: str, model_file: str, *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(row, id, start, end, a_ids, b_ids): every group with its bytes, counted from the blank before
    the text."""
    files = _sent(docs, tokenizer_file, model_file)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))

    def computed(batches):
        for _, part, _, t in _runs(batches, files):
            if not len(t.a):
                continue
            a_last, b_last = _last(t.a_group), _last(t.b_group)
            of = np.searchsorted(t.a_of, a_last, side="right") - 1
            end = t.a_end[a_last]
            start = np.concatenate([[0], end])[:-1]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]).astype(np.int32)),
                                              pa.array(ids)) for last, ids in ((a_last, t.a), (b_last, t.b))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)),
                 pa.array(start - t.base[of]), pa.array(end - t.base[of]), *lists],
                names=["row", "id", "start", "end", "a_ids", "b_ids"])

    return narrow.mapInArrow(
        computed, f"row long, id {kind}, start long, end long, a_ids array<long>, b_ids array<long>")


def token_overlaps(docs: DataFrame, tokenizer_file: str, model_file: str, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(row, id, a_at, b_at, a_id, b_id, together): every pair of tokens that share a byte, by their
    places in the document; `together` if they end at the same byte."""
    files = _sent(docs, tokenizer_file, model_file)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))

    def computed(batches):
        for _, part, _, t in _runs(batches, files):
            if not len(t.a):
                continue
            i, j = overlaps(t.a_end, t.b_end)
            of = np.searchsorted(t.a_of, i, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)),
                 pa.array(i - t.a_of[of]), pa.array(j - t.b_of[of]), pa.array(t.a[i]), pa.array(t.b[j]),
                 pa.array(t.a_end[i] == t.b_end[j])],
                names=["row", "id", "a_at", "b_at", "a_id", "b_id", "together"])

    return narrow.mapInArrow(
        computed, f"row long, id {kind}, a_at long, b_at long, a_id long, b_id long, together boolean")
