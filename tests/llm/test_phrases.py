"""License scans and phrase mining against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skylattice.llm import collocations, licenses
from skylattice.llm.licenses import Template

SCHEMA = "doc_id long, text string, n_words string, row string, label int"
TEMPLATES = [
    Template("two", "Alpha beta", ordered=True, base=True), Template("one", "gamma", ordered=True, base=True),
    Template("twice", "beta beta", ordered=True), Template("short", "w1 w2 w3 w4 w5 alpha"),
    Template("long", " ".join(f"t{i}" for i in range(12)) + " alpha"), Template("none", " . "),
]


def license_rows(rng):
    common = ["alpha", "beta", "ALPHA", "w1", "w2", "x", "y", "ünï", "w3"]
    rows = [(None, None), (1, ""), (2, "gamma"), (2, "gamma"), (3, "alpha-beta\nBETA.beta alpha"), (4, "!!")]
    for i in range(5, 90):
        text = [rng.choice(common) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            name = rng.choice(TEMPLATES[:5]).text.split()
            if rng.random() < 0.5:
                name = [w for w in name if rng.random() < 0.85]
            at = rng.randint(0, len(text))
            text[at:at] = name
        rows.append((i if rng.random() < 0.9 else None, rng.choice([" ", ", ", "\n"]).join(text)))
    hot = " ".join(rng.choice(common) for _ in range(300))
    return rows + [(500 + k, hot) for k in range(40)] + [(900, "gamma " + "x y " * 60_000 + "alpha beta")]


def license_by_hand(text, step):
    held = licenses.words(text or "")
    blocks = [set(held[s:s + 2 * step]) for s in range(0, len(held), step)]
    starts, base, labels, score = [], set(), set(), 0.0
    for t in TEMPLATES:
        want = licenses.words(t.text)
        if not want:
            continue
        if t.ordered:
            at = [i for i in range(len(held)) if held[i:i + len(want)] == want]
            if at:
                labels.add(t.label)
                score = 1.0
            if t.base and at:
                starts += at
                base.add(t.label)
        else:
            share = max((len(b & set(want)) / len(set(want)) for b in blocks), default=0)
            if share >= 0.8:
                labels.add(t.label)
                score = max(score, share)
    return (len(held), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_licenses_found_as_by_hand(spark):
    rows = license_rows(random.Random(5))
    docs = spark.createDataFrame([(*r, "clash", "x", 1) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs, TEMPLATES).collect()), key=repr)
    assert got == sorted(((i, *license_by_hand(t, 13)) for i, t in rows), key=repr)
    assert len({r[6] for r in got}) > 5


def test_licenses_without_documents_or_templates(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(empty, TEMPLATES).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA)
    for none in ([], [Template("none", "?")]):
        assert licenses.scan_licenses(one, none).collect()[0][1:] == (2, 0, None, None, "", "", 0.0)
    with pytest.raises(ValueError):
        licenses.scan_licenses(one, [Template("huge", "w " * (licenses.MAX_WORDS + 1))])


def phrase_rows(rng):
    frequent = [f"f{i}" for i in range(12)] + ["The", "é", "a\x00b"]
    rows = [(None, None, None), (1, "", "en"), (2, " \t ", None), (3, "...", "en")]
    for i in range(4, 60):
        words = [rng.choice(frequent) if rng.random() < 0.8 else f"rare{rng.randint(0, 400)}"
                 for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([["new", "york", "city", "hall"], ["big", "apple"], ["aa"] * 5])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "?"]) for w in words)
        rows.append((i if rng.random() < 0.9 else None, text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(900 + k, rows[10][1], "en") for k in range(15)]


def counts_by_hand(rows):
    counts = Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            held = re.findall(r"[^\x20\x09]+", piece)
            for d in range(1, 5):
                for i in range(len(held) - d + 1):
                    counts["und" if lang is None else lang, tuple(held[i:i + d])] += 1
    return counts


def collocations_by_hand(rows, least, top):
    counts = counts_by_hand(rows)
    total = Counter()
    for (lang, held), f in counts.items():
        total[lang] += f * (len(held) == 1)
    candidates = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    scored = defaultdict(list)
    for (lang, held), a in candidates.items():
        if any(100 * f >= 80 * a for (other, longer), f in candidates.items()
               if other == lang and len(longer) > len(held)
               and any(longer[i:i + len(held)] == held for i in range(len(longer)))):
            continue
        cuts = [(2_000_000 * a // (counts[lang, held[:k]] + counts[lang, held[k:]]), k) for k in range(1, len(held))]
        score, k = min(cuts)
        scored[lang].append((-score, -a, " ".join(held).encode(), counts[lang, held[:k]], counts[lang, held[k:]]))
    return {(lang, r, phrase.decode(), -a, l, right, total[lang], -score)
            for lang, found in scored.items()
            for r, (score, a, phrase, l, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("words, top, limit", [
    (60, 2000, 0), (60, 2000, 70), (60, 2000, collocations.BROADCAST_ROWS), (100_000, 5, 10 ** 6)])
def test_collocations_summed_over_shards(spark, words, top, limit):
    rows = phrase_rows(random.Random(8))
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows],
                                 "doc_id long, text string, lang string, word string, n int").repartition(4)
    got = collocations.collocations(docs, least=8, top=top, shard_words=words,
                                     broadcast_rows=limit).collect()
    want = collocations_by_hand(rows, 8, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10
    assert "city hall" in {r["phrase"] for r in got} or top < 10


def test_phrase_tables_hold_extensions(spark):
    rows = phrase_rows(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tables, _ = collocations.phrases(docs, least=8, shard_words=200)
    counts = counts_by_hand(rows)
    for d, table in enumerate(tables, 1):
        got = {(r["lang"], tuple(bytes(w).decode() for w in r["words"])): r for r in table.collect()}
        assert {k: r["a"] for k, r in got.items()} == {k: f for k, f in counts.items() if len(k[1]) == d and f >= 8}
        for (lang, held), r in got.items():
            assert r["heads"] == [counts[lang, held[:k]] for k in range(1, d)]
            assert r["tails"] == [counts[lang, held[-k:]] for k in range(1, d)]


def test_index_intervals_count_phrases():
    rng = np.random.default_rng(3)
    ids = np.concatenate([[0], rng.integers(0, 6, 400), [0]]).astype(np.int32)
    index = collocations.Index(ids)
    words = np.flatnonzero(index.counts[1:]) + 1
    level = [((int(w),), a, b, n) for w, a, b, n in zip(words, *index.words(words))]
    for side in (collocations.RIGHT, collocations.LEFT, collocations.RIGHT):
        starts = [np.array([x[1] for x in level]), np.array([x[2] for x in level])]
        owner, ahead, back, size = index.extend(side, starts, np.array([x[3] for x in level]))
        transform = index.halves[side][0]
        grown = []
        for o, a, b, n in zip(owner, ahead, back, size):
            row = starts[side][o]
            symbols = transform[row:row + level[o][3]]
            nth = sum(1 for k in owner[:len(grown)] if k == o)
            symbol = int(np.unique(symbols[symbols > 0])[nth])
            held = (symbol, *level[o][0]) if side == collocations.LEFT else (*level[o][0], symbol)
            grown.append((held, int(a), int(b), int(n)))
        level = grown
        seen = Counter(tuple(ids[i:i + len(level[0][0])].tolist()) for i in range(len(ids)))
        want = {k: n for k, n in seen.items() if len(k) == len(level[0][0]) and 0 not in k}
        assert {x[0]: x[3] for x in level} == want


def test_collocations_of_nothing(spark):
    schema = "doc_id long, text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(1, "a b. c", None), (2, None, "en")], schema)
    assert collocations.collocations(few).count() == 0
    assert collocations.collocations(few, least=1).first()["phrase"] == "a b"
