"""Two tokenizers over the same bytes, against token pairs compared one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skylattice.llm import align

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, row string"
TEXTS = [
    "hello world", "", None, " leading  blanks ", "wörld ▁ mark", "日本語 text 😀 é", "a\x00b\tc\n\nd",
    "<|endoftext|> and <s> </s> <unk>", "x" * 700, "hello world", "The quick brown fox. The quick brown fox.",
    " odd spaces　", "naïve café — “quotes”", "the the the and of the", " ",
]


def by_hand(texts):
    left = Tokenizer.from_file(A_FILE)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    code = align.byte_characters()
    docs = []
    for text in texts:
        if not text:
            docs.append(([], [], []))
            continue
        a = left.encode(" " + text, add_special_tokens=False)
        b = right.encode(text)
        a_bytes = [bytes(code[c] for c in token) for token in a.tokens]
        b_bytes = []
        for i in b:
            piece = right.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:-1], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode())
        want = b" " + text.encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append(([], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, ends = 0, []
            for part in parts:
                ends.append((at, at + len(part)))
                at += len(part)
            spans.append(ends)
        links = [(x, y) for x, (_, e) in zip(a.ids, spans[0]) for y, (_, f) in zip(b, spans[1]) if e == f]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for cut in cuts:
            groups.append((start, cut, [x for x, (s, e) in zip(a.ids, spans[0]) if start <= s and e <= cut],
                           [y for y, (s, e) in zip(b, spans[1]) if start <= s and e <= cut]))
            start = cut
        pairs = [(i, j, e == f) for i, (s, e) in enumerate(spans[0]) for j, (u, f) in enumerate(spans[1])
                 if max(s, u) < min(e, f)]
        docs.append((groups, links, pairs))
    return docs


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", "x") for i, t in enumerate(TEXTS)],
                                 SCHEMA).repartition(3)


@pytest.mark.parametrize("limit", [0, align.BROADCAST_ROWS])
def test_alignment_counts_and_digests(table, limit):
    docs = by_hand(TEXTS)
    counts = Counter(link for _, links, _ in docs for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = {}
    for i, (groups, links, _) in enumerate(docs):
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for _, _, a, b in groups)
        want[None if i == 3 else i] = (
            sum(len(g[2]) for g in groups), sum(len(g[3]) for g in groups), len(groups), len(links),
            sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(written.encode()).hexdigest() if groups else "")
    got = align.alignment(table, A_FILE, B_FILE, broadcast_rows=limit).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(TEXTS)
    assert want[4][:4] == (0, 0, 0, 0) and want[2][-1] == ""  # the mark itself is read as a blank


def test_groups_and_overlaps_expand(table):
    docs = by_hand(TEXTS)
    got = defaultdict(list)
    for r in align.token_groups(table, A_FILE, B_FILE).collect():
        got[r["id"]].append((r["start"], r["end"], r["a_ids"], r["b_ids"]))
    pairs = defaultdict(list)
    for r in align.token_overlaps(table, A_FILE, B_FILE).collect():
        pairs[r["id"]].append((r["a_at"], r["b_at"], r["together"]))
    for i, (groups, _, near) in enumerate(docs):
        i = None if i == 3 else i
        assert sorted(got[i]) == groups and sorted(pairs[i]) == sorted(near)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert align.alignment(empty, A_FILE, B_FILE).count() == 0
    only = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert align.alignment(only, A_FILE, B_FILE).collect()[0].asDict() == {
        "doc_id": 1, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0,
        "groups_sha256": ""}


def test_units_give_the_tokens_of_whole_texts():
    pair = align.Pair(align._read(A_FILE), align._read(B_FILE))
    assert pair.by_unit
    rng, signs = random.Random(1), " " * 8 + "abé'sllA1.,\n\t日\x85 \xa0<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += ["x" * 200 + " y" * 3000, "", None]
    for part in (texts, texts[:50]):
        t = pair.tokens(part)
        for i, text in enumerate(part):
            a, b = t.a[t.a_of[i]:t.a_of[i + 1]].tolist(), t.b[t.b_of[i]:t.b_of[i + 1]].tolist()
            want = pair.left.encode(" " + text, add_special_tokens=False).ids if text else []
            assert (a, b) == (want, pair.right.encode(text) if text else [])
