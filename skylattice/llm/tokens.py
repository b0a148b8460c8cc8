"""Token counts of a byte-pair vocabulary, by a heap over a linked list of symbols.

No token identifier is ever formed: a text starts with one symbol per character, every merge
removes one, and what is left is the count.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
MEMO_WORDS = 400_000
MEMO_LENGTH = 64


def piece_ranks(model_file: str) -> dict[str, int]:
    """Rank of every ordinary piece of a sentencepiece model, best score first, equal scores
    sharing a rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores = {
        model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    }
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return {p: order[s] for p, s in scores.items()}


def merges(text: str, ranks: dict[str, int]) -> tuple[int, list[int]]:
    """Number of merges, and the ends of the symbols by start (0 for a start that was merged)."""
    n = len(text)
    ends = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(text[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, left, right, end = heapq.heappop(heap)
        if ends[left] != right or ends[right] != end:
            continue  # one of the two has been merged since
        ends[left], ends[right] = end, 0
        done += 1
        if end < n:
            before[end] = left
            rank = ranks.get(text[left:ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end, ends[end]))
        previous = before[left]
        if previous >= 0:
            rank = ranks.get(text[previous:end])
            if rank is not None:
                heapq.heappush(heap, (rank, previous, left, end))
    return done, ends


def unit_count(text: str, ranks: dict[str, int]) -> int:
    """Tokens of one unit; a character that is no piece falls back to its bytes."""
    if text in ranks and len(text) == 1:
        return 1
    done, ends = merges(text, ranks)
    count = len(text) - done
    for i, end in enumerate(ends):
        if end == i + 1 and text[i] not in ranks:
            count += len(text[i].encode("utf-8", "surrogatepass")) - 1
    return count


class _Memo(dict):
    """Counts of units seen before; `prefix` is the mark that a space in front leaves."""

    def __init__(self, ranks: dict[str, int], prefix: str):
        super().__init__()
        self.ranks, self.prefix = ranks, prefix

    def __missing__(self, word: str) -> int:
        count = unit_count(self.prefix + word, self.ranks)
        if len(word) <= MEMO_LENGTH:
            self[word] = count
        return count


class TokenCounter:
    """Counts tokens of whole texts. A text is cut where no piece of the vocabulary reaches
    across: before a run of marks, and on both sides of a line feed, if the vocabulary allows it
    (else the text is one unit)."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.by_space = not any(
            a != MARK and b == MARK for p in ranks for a, b in zip(p, p[1:]))
        self.by_line = not any("\n" in p for p in ranks)
        self.inner, self.first = _Memo(ranks, MARK), _Memo(ranks, "")
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _line(self, line: str, marked: bool) -> int:
        """`marked`: a mark stands before the line."""
        if not line and not marked:
            return 0
        if not self.by_space:
            return unit_count((MARK if marked else "") + line.replace(" ", MARK), self.ranks)
        if MARK in line or "  " in line or line[:1] == " " or line[-1:] in ("", " "):
            whole = (MARK if marked else "") + line.replace(" ", MARK)
            return sum(map(self.first.__getitem__, self.units.findall(whole)))
        words = line.split(" ")
        count = 0
        if not marked:
            count = self.first[words[0]]
            del words[0]
        return count + sum(map(self.inner.__getitem__, words))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.inner) + len(self.first) > MEMO_WORDS:
            self.inner.clear()
            self.first.clear()
        if not self.by_line:
            return self._line(text, True)
        lines = text.split("\n")
        feeds = (len(lines) - 1) * self.first["\n"]
        return feeds + self._line(lines[0], True) + sum(self._line(x, False) for x in lines[1:])


def count_tokens(docs: DataFrame, model_file: str, *, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the model's own library counts
    without begin or end tokens. A null text counts as empty: 0 bytes, 0 tokens. Rows are neither
    joined nor moved, so ids may be null or repeated. The ranks are one entry per vocabulary
    piece; executors need no file."""
    ranks = docs.sparkSession.sparkContext.broadcast(piece_ranks(model_file))
    id_type = docs.schema[id_col].dataType.simpleString()

    def counted(batches):
        counter = TokenCounter(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            counts = np.fromiter(
                (counter.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts)],
                names=[id_col, "n_bytes", "n_tokens"])

    narrow = docs.select(
        id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"`{id_col}` {id_type}, n_bytes long, n_tokens long"
    return narrow.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
