"""Shards, mixing, near-duplicates, contamination, vectors and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import decontaminate, mixing, ring, simhash, vectors
from skylattice.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 1) for r in rows], SCHEMA)


def rooted(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 4)]
    links += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    want = rooted({n for link in links for n in link}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shard_rows(rng, n=400):
    texts = [f"text {rng.randint(0, 60)}" for _ in range(n)]
    rows = [(i, t if rng.random() < 0.6 else "the hot text", None, None) for i, t in enumerate(texts)]
    return rows + [(None, None, None, None), (None, "", None, None), (3, rows[3][1], None, None)]


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_shards_follow_the_ring(spark, slack):
    rows, shards, nodes = shard_rows(random.Random(9)), 5, 4
    got = ring.shard_documents(docs_of(spark, rows), shards, nodes=nodes, slack=slack).collect()
    # one key after the other: each fills its own shard in ring order, then the rest walk on
    places, owners = ring.virtual_nodes(shards, nodes)

    def place(text):
        return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64))

    room = ring.capacities(len(rows), shards, slack)
    order = sorted((place(t), (-1 if i is None else i)) for i, t, _, _ in rows)
    seated, waiting = Counter(), []
    for p, i in order:
        at = int(np.searchsorted(places, p)) % len(owners)
        if room[owners[at]]:
            room[owners[at]] -= 1
            seated[(i, int(owners[at]))] += 1
        else:
            waiting.append((at, i))
    for at, i in waiting:
        while not room[owners[at]]:
            at = (at + 1) % len(owners)
        room[owners[at]] -= 1
        seated[(i, int(owners[at]))] += 1
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["shard"]) for r in got) == seated
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not slack:
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {i: t for i, t, _, _ in rows}
    for r in got:
        if r["doc_id"] is not None:
            raw = text[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_shards_of_nothing_and_of_few(spark):
    assert ring.shard_documents(docs_of(spark, []), 4).count() == 0
    got = ring.shard_documents(docs_of(spark, [(1, "a", None, None), (2, "a", None, None)]), 40)
    assert len({r["shard"] for r in got.collect()}) == 2


def mix_by_hand(rows, weights, most):
    def size(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    return sizes, target, size


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "hot", "hot", "é", None, "Z", "b"]))
            for i in range(300)]
    rows += [(900, "x y", None, "tiny"), (901, None, None, "void"), (None, "p q", None, "hot"),
             (5, rows[5][1], None, rows[5][3])]
    sizes, target, size = mix_by_hand(rows, [5, 2, 1], 3)
    got = mixing.mix_sources(docs_of(spark, rows), weights=[5, 2, 1]).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - target[r["source"]]) < 1e-4
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in sizes)
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    again = mixing.mix_sources(docs_of(spark, rows[::-1]).repartition(5), weights=[5, 2, 1]).collect()
    assert Counter(again) == Counter(got)
    assert mixing.mix_sources(docs_of(spark, []), weights=[1]).count() == 0
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.repeat_by_mix(docs_of(spark, rows), weights=[5, 2, 1])
    assert mixed.columns == docs_of(spark, []).columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies


def fingerprint_by_hand(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows(rng):
    rows = []
    for i in range(60):
        words = [rng.choice(["ab", "cd", "É", "fg", "hi"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(words), "en", "s"))
        for k in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = "zz"
            rows.append((1000 + 10 * i + k, "\n".join(words).upper(), "en", "s"))
    return rows + [(500, None, "en", "s"), (501, "", "en", "s"), (502, "w " * 20_000, "en", "s"),
                   (3, rows[3][1], "en", "s"), (None, rows[0][1], "en", "s"), (None, "alone", "en", "s")]


def test_simhash_groups_lose_no_link(spark):
    rows = near_rows(random.Random(8))
    prints = [fingerprint_by_hand(t) for _, t, _, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = rooted(range(len(rows)), links)
    ids = defaultdict(list)
    for i, r in root.items():
        if rows[i][0] is not None:
            ids[r].append(rows[i][0])
    want = Counter((rows[i][0], f"{prints[i]:016x}", min(ids[r], default=None)) for i, r in root.items())
    docs = docs_of(spark, rows)
    groups = simhash.simhash_groups(docs)
    got = Counter(map(tuple, groups.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()))
    assert got == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    firsts = Counter(min(ids[r], default=None) for r in set(root.values()))
    assert Counter(r["doc_id"] for r in kept.collect()) == firsts
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_close_fingerprints_in_one_hot_half(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = list({base ^ sum(1 << b for b in rng.sample(range(32), rng.randint(0, 6))) for _ in range(300)})
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    found = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    got = {r["node"]: r["root"] for r in found.collect()}
    want = rooted(signed, [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i)
                           if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def words_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def judged_by_hand(text, items, size):
    words, hit, met = words_by_hand(text), set(), set()
    for item, body in items:
        its = words_by_hand(body)
        k = min(size, len(its))
        for s in range(len(its) - k + 1 if its else 0):
            for at in range(len(words) - k + 1):
                if words[at:at + k] == its[s:s + k]:
                    hit.update(range(at, at + k))
                    met.add(item)
    ids = sorted(str(i) for i in met if i is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "one two three four five six"), (10, "One, two three"), (2, "É x"), (3, ""), (4, None),
         (5, "the the the the the the"), (None, "seven"), (6, "one two three four five six"), (7, "!?")]
TEXTS = ["zero ONE two\nthree four five six seven", None, "", "one two three five", "the " * 9, "É x é x",
         "é x", "one two three four", "un deux", "the the the", "one-two-three " * 3, "seven", "x " * 20_000]


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_contamination_is_exact(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, None), (None, TEXTS[0], None, None)]
    docs = docs_of(spark, rows)
    got = Counter(map(tuple, decontaminate.contamination(docs, items, size=4).drop("text_key").collect()))
    assert got == Counter((i, *judged_by_hand(t, ITEMS, 4)) for i, t, _, _ in rows)
    clean = decontaminate.drop_contaminated(docs, items, size=4)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(
        i for i, t, _, _ in rows if not judged_by_hand(t, ITEMS, 4)[-1])


def test_contamination_of_and_by_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = docs_of(spark, [(1, "one two three", None, None)])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()] == [0]


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    docs = docs_of(spark, [(1, "alpha x beta gamma", None, None), (2, "alpha beta", None, None),
                           (3, "alpha x y z beta gamma", None, None), (4, "beta alpha gamma", None, None)])
    windows = decontaminate.phrase_windows(items, 10)
    vocab = decontaminate.vocabulary(windows)
    index = decontaminate.build_index(docs, vocab)
    terms = decontaminate.ranked_terms(windows, vocab, index)
    near = decontaminate.proximity_matches(index, terms, slop=1).join(
        index.select("row", "doc_id").distinct(), "row")
    assert {r["doc_id"] for r in near.collect()} == {1, 4}
    assert decontaminate.phrase_matches(index, terms).count() == 0


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "MEMBERS", block)
    monkeypatch.setattr(vectors, "ASKERS", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + rng.normal(size=12) * 0.1).tolist()) for i in range(80)]
    rows += [(300 + i, base[3].tolist()) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 12), (402, [1.0, None] + [0.0] * 10), (403, [math.inf] + [1.0] * 11),
             (404, []), (405, [2.0] * 5), (406, [1.0] * 5), (3, base[3].tolist()), (407, (base[5] * 1e200).tolist())]
    usable = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in usable}
    links = [(i, j) for i in usable for j in usable if i != j and len(scaled[i]) == len(scaled[j])
             and cosine(scaled[i], scaled[j]) >= 0.9]
    degree = Counter(i for i, _ in links)
    root = rooted(range(len(rows)), links)
    least = defaultdict(lambda: 10**9)
    for i, r in root.items():
        least[r] = min(least[r], rows[i][0])
    want = Counter((rows[i][0], degree[i], least[r], least[r] == rows[i][0]) for i, r in root.items())
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows],
                                  "vec_id long, embedding array<double>, label int, rep string")
    assert Counter(map(tuple, vectors.near_vectors(frame, probes=60).collect())) == want
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_vector_recall_with_few_probes(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(150, 32))
    x = np.repeat(centers, 8, axis=0) + rng.normal(size=(1200, 32)) * 0.25
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(x)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vectors.near_vectors(frame).agg(F.sum("n_links")).first()[0]
    assert 0.9 * true <= found <= true


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, tmp_path, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    messy = [(1, None, None, None, None), (None, "the cat", "en", None, 7), (2, "", "de", "", 0),
             (3, "w " * 20_000, "en", "s", 1), (4, "the cat", "en", "s", 7), (4, "the cat", "en", "s", 7),
             (5, "été 12", None, "s", None)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (messy, []):
        docs = spark.createDataFrame(rows, schema)
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert len(got) <= 3 * len(rows)
        if name != "shards":
            assert out.columns == docs.columns
        if name in ("decontaminate", "shards"):
            assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        if name == "simhash" and rows:
            # both null and empty texts have fingerprint zero; the repeated row is one document
            assert Counter(r["doc_id"] for r in got) == Counter([1, 3, 4, 5])


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    words = {"en": ["the", "and", "of", "with", "house", "said", "not", "all"],
             "de": ["und", "der", "nicht", "haus", "ist", "auf", "ein", "sagt"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(20, 50))), lang, f"s{i % 4}"))
    leak = " ".join(rng.choices(words["en"], k=14))
    rows += [(900, rows[0][1], "en", "s0"), (901, "123 456", "en", "s0"), (902, None, None, None),
             (903, "so " + leak + " end", "en", "s1")]
    docs = docs_of(spark, rows).drop("size", "_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
        left[name] = Counter(r["doc_id"] for r in read.collect())
        if name != "shards":
            assert read.columns == docs.columns
    assert {901, 902}.isdisjoint(left["language"]) and len(left["language"]) >= 240
    assert 900 not in left["simhash"] and set(range(240)) <= set(left["simhash"])
    assert set(left["simhash"]) - set(left["decontaminate"]) == {903}
    assert set(left["mix"]) <= set(left["decontaminate"])
    assert left["shards"] == left["mix"]
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == left["shards"]


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def without_copies(texts):
    """Ids left, from {id: text}: the smallest of each group connected by Jaccard of 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {i for i, root in rooted(ids, pairs).items() if i == root}


def edited(rng, words, most):
    """The words with some single words replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), rng.randint(0, most)):
        out[i] = f"new{rng.randint(0, 10**6)}"
    return out


def near_copy_texts(rng):
    line = " a line that very many of the texts have in common with the others"
    texts = {}
    for _ in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 9, 60, 120, 300]))]
        for _ in range(rng.randint(1, 8)):
            most = max(1, len(words) // 80)
            texts[len(texts)] = " ".join(edited(rng, words, most)) + (line if rng.random() < 0.5 else "")
            if rng.random() < 0.3:
                words = edited(rng, words, most)  # chains, whose ends are not alike
    texts |= {len(texts) + k: t for k, t in enumerate(
        ["", None, "one", "One", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g", " ".join(["w"] * 50)])}
    return texts


def test_near_copies_of_five_words_against_brute_force(spark):
    for seed in (3, 4):
        texts = near_copy_texts(random.Random(seed))
        sets = {i: shingle_set(t) for i, t in texts.items()}
        near = sum(0.8 <= jaccard(sets[a], sets[b]) <= 0.95 for a in sets for b in sets if a < b)
        assert near >= 20  # the two bits of operator 8 link hardly any of these
        docs = docs_of(spark, [(i, t, "en", "s") for i, t in texts.items()])
        out = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert out.columns == docs.columns
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(without_copies(texts))


def test_simhash_refuses_distances_its_keys_would_miss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_DISTANCE", 3)
    with pytest.raises(ValueError, match="two bits"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"))
