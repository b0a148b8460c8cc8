"""Token counts, URL rules, language, quality and language-model scores on small messy tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import buffers, language, maxent, quality, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, size string, `key.` int"
LONG = "word " * 30_000


def messy(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "The cat sat.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "x", "de", "b"),
        (4, LONG, "en", "b"), (5, "The cat sat.", "en", "a"), (5, "The cat sat.", "en", "a"),
        (6, " \t\n", "fr", ""), (7, "12 34 !?", "fr", "c"), (8, "日本語 テスト é", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def model_file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_flat_handles_slices_nulls_and_empty():
    data, offsets = buffers.flat(pa.array(["ab", None, "", "é"]).slice(1))
    assert offsets.tolist() == [0, 0, 0, 2] and bytes(data) == "é".encode()
    assert buffers.flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_spans_match_split():
    random.seed(2)
    texts = ["".join(random.choice(" a\né\tb") for _ in range(random.randint(0, 12))) for _ in range(300)]
    data, offsets = buffers.flat(pa.array(texts))
    found = [[] for _ in texts]
    for a, b, part, ends in buffers.chunks(data, offsets, limit=50, most=7):
        starts, stops, rows = buffers.spans(part, ends)
        for s, e, r in zip(starts, stops, rows):
            found[a + r].append(bytes(part[s:e]))
    assert found == [t.encode().split() for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    data, offsets = buffers.flat(pa.array(["one two one", "two"]))
    starts, ends, _ = buffers.spans(data, offsets)
    h = buffers.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_token_counts_equal_the_library(spark, model_file):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    random.seed(1)
    bits = ["a", "the", " ", "  ", "\n", "▁", "\t", "é", "龘", "<s>", "</s>", "\0", "in", "ing", "😀",
            "<0x0A>", "\r\n", "ｗ", "\u00a0", "."]
    texts = ["".join(random.choices(bits, k=random.randint(0, 15))) for _ in range(400)]
    docs = messy(spark, [(i, t, None, None) for i, t in enumerate(texts)]).union(messy(spark))
    got = tokens.count_tokens(docs, model_file, limit=10).collect()
    want = Counter()
    for row in docs.collect():
        text = row["text"] or ""
        n = len(library.encode(text))
        want[(row["doc_id"], len(text.encode()), n, n > 10)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_tokens_of_an_empty_table(spark, model_file):
    assert tokens.count_tokens(messy(spark, []), model_file).count() == 0


def test_units_are_whole_texts_when_pieces_span_words():
    counter = tokens.TokenCounter({"a": 3, "▁": 2, "a▁": 0, "▁a": 1, "a\n": 4})
    assert not counter.by_space and not counter.by_line
    assert counter.count("a a") == tokens.unit_count("▁a▁a", counter.ranks)


RULES = [("block", "com", "/en/"), ("allow", "Example.com", "/en/7"), ("allow", "net", "/de/"),
         ("block", "net", "/de/"), ("allow", "org", "")]
URLS = ["http://a.EXAMPLE.com/en/71?x", "http://example.com/en/81", "https://notexample.com/en/7", None,
        "", "example.com/en/7", "http://net/de/#f", "http://xnet/de/", "http://a.org", "http://",
        "ftp://u@h.org:80/x://y", "http://example.com?/en/7", "http://com/en", "http://é.com/en/"]


def expected(url):
    host, path = urls.split_url(url)
    fit = [(len(h) + len(p), len(h), h.lower() + p, v) for v, h, p in RULES
           if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    most = max(fit)[:3]
    verdicts = {f[3] for f in fit if f[:3] == most}
    return host, path, most[2], "block" if "block" in verdicts else "allow"


def test_urls_and_the_join_agree_with_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, host string")
    got = {tuple(r) for r in urls.judge_urls(pages, RULES).collect()}
    assert got == {(i, *expected(u)) for i, u in enumerate(URLS)}
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert {tuple(r) for r in urls.judge_by_join(pages, rules).collect()} == got
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart_by_the_text(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "_digest", lambda text: 5)
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda text, *seed: 5)
    urls.DigestFile.write(str(tmp_path / "d"), [("block", "a", "/"), ("allow", "b", "/")])
    index = urls.DigestFile(str(tmp_path / "d"))
    found = index.find([b"a/", b"b/", b"c/"])
    assert [bool(index.block[i]) for i in found[:2]] == [True, False] and found[2] == -1


def speech(n, seed=0):
    rng = random.Random(seed)
    words = {"en": ["the", "and", "of", "with", "house"], "de": ["und", "der", "nicht", "haus", "ist"],
             "fr": ["et", "le", "maison", "est", "une"]}
    for i in range(n):
        lang = rng.choice(list(words))
        yield i, " ".join(rng.choices(words[lang], k=rng.randint(3, 12))), lang, "s"


def test_language_is_learned_and_null_or_wordless_is_unknown(spark):
    docs = messy(spark, list(speech(300))).union(
        messy(spark, [(900, None, "en", "s"), (901, "12 !!", "de", "s"), (902, "", None, None),
                      (903, "日本", None, None), (904, "Der Haus Und " * 20_000, None, None)]))
    model = language.fit_languages(docs, training=F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert model["names"] == ["de", "en", "fr"]
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in speech(300) if i % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und", "und", "und", "de"]
    assert got[903]["lang_pred"] != "und" and got[900]["lang_score"] == 0
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert got[1]["size"] == "clash"


def test_language_without_training_rows(spark):
    docs = messy(spark)
    model = language.fit_languages(docs, training=F.lit(False))
    assert {r["lang_pred"] for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4, 6, 9])
def test_codewords_are_apart(k):
    code = language.codebook(k)
    assert code.shape[0] == k and len({tuple(r) for r in code.tolist()}) == k


def test_quality_from_positives_and_unlabelled(spark):
    good = [(i, t, lang, s) for i, t, lang, s in speech(400, 3)]
    rows = [(i, t if i % 3 else "$$$ ### " * (1 + i % 9), lang, s) for i, t, lang, s in good]
    docs = messy(spark, [*rows, (900, None, None, None), (901, "", None, None), (902, LONG, None, None)])
    labels = spark.createDataFrame(
        [(i, int(bool(i % 3))) for i in range(0, 400, 2)] + [(None, 1), (3, None)],
        "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, training=F.col("doc_id") % 5 != 0)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.3) == bool(r["doc_id"] % 3) for r in got if r["doc_id"] < 400 and r["doc_id"] % 5 == 0]
    assert np.mean(held) > 0.95
    none = quality.fit_quality(docs, labels.limit(0), training=F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(5)
    positive = rng.normal(2, 1, (1500, 3)).astype(np.float32)
    mixed = np.concatenate([rng.normal(2, 1, (900, 3)), rng.normal(-2, 1, (600, 3))]).astype(np.float32)
    assert abs(quality.estimate_prior(positive, rng.permutation(mixed)) - 0.6) < 0.08


def test_language_model_scores(spark):
    docs = messy(spark, list(speech(200, 7))).union(messy(spark, [
        (900, None, None, None), (901, "", None, None), (902, "neverseen THE the", None, None),
        (None, "the and", None, None), (903, "the of " * 20_000, None, None)]))
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    rows = docs.select("doc_id", "text", training.alias("t")).collect()
    tokens_of = [(r["text"] or "").encode().lower().split() + [b" "] for r in rows]
    counts = Counter(w for r, ws in zip(rows, tokens_of) if r["t"] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), round(math.fsum(
        math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for r, ws in zip(rows, tokens_of))
    for share in (maxent.HEAD_SHARE, 1):  # 1: every word is joined
        was, maxent.HEAD_SHARE = maxent.HEAD_SHARE, share
        try:
            got = maxent.score_texts(docs, training=training).collect()
        finally:
            maxent.HEAD_SHARE = was
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6))
                      for r in got) == want
        assert {r["train_tokens"] for r in got} == {n}
        assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(0)
    model = maxent.Model(rng.integers(0, 50, maxent.LEAVES).astype(float), rng.integers(0, 5, maxent.LEAVES))
    for w in model.weights:
        w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    context = [np.full(maxent.LEAVES, x, np.uint32) for x in (3, 77, 1234567)]
    assert abs((10 ** model.log10(context, np.arange(maxent.LEAVES))).sum() - 1) < 1e-4


def test_language_model_without_training(spark):
    got = maxent.score_texts(messy(spark), training=F.lit(False)).collect()
    assert len(got) == 10 and {(r["n_known"], r["base_score"], r["train_tokens"]) for r in got} == {(0, 0.0, 0)}
    assert maxent.score_texts(messy(spark, []), training=F.lit(True)).count() == 0
    assert zlib.crc32(b"") == 0


def test_samples_are_bounded_by_rows_not_ids(spark, monkeypatch):
    """One id holds nearly all rows, with different and equal texts; every language is picked at once."""
    rows = [(7, f"hot words {i % 3000}", "en" if i % 2 else "de", 1) for i in range(20_000)]
    rows += [(i, f"some text {i}", "fr", None) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark int").repartition(6)
    seen = []
    fit_bits, fit_network = language.fit_bits, quality.fit_network
    monkeypatch.setattr(language, "fit_bits", lambda x, bits: seen.append(len(x)) or fit_bits(x, bits, steps=2))
    model = language.fit_languages(docs, training=F.lit(True), sample_rows=60)
    assert model["names"] == ["de", "en", "fr"] and 20 < seen[0] <= 60
    labels = spark.createDataFrame([(7, 1), (7, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit_network",
                        lambda p, u, prior: seen.append((len(p), len(u))) or fit_network(p, u, prior, epochs=1))
    quality.fit_quality(docs, labels, training=F.lit(True), positive_rows=50, unlabelled_rows=20)
    assert seen[1] == (50, 20)
