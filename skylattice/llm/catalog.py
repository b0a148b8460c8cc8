"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skylattice.llm import align, collocations, decontaminate, language, licenses, maxent, mixing, quality
from skylattice.llm import ring, simhash, tokens, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_crc() % 5 == 0
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), training=~held_out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

OP4_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
 rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
   THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
 cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz') AS host, substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path
   FROM rest),
 fits AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id
     ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
   FROM cut, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT cut.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN fits ON cut.page_id = fits.page_id AND n = 1"""

MIX_WEIGHTS = [5, 2, 1]


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
 sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 dealt AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
   WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS cap FROM sources),
 steps AS (SELECT *, cap / weight AS fill,
   (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM dealt),
 targets AS (SELECT source, source_size, round(least(cap, coalesce(
   (SELECT min_by(level, fill) FROM steps WHERE level <= fill), 0e0) * weight), 6) AS target
   FROM steps),
 plan AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) AS budget FROM targets),
 placed AS (SELECT s.doc_id, s.size, p.source_size, p.target,
   CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs,
   CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END AS rest,
   coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source
     ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
   FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, rest - ahead)) AS taken
FROM placed"""


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = language.fit_languages(docs, training=~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"),
                        F.col("lang_ambiguous").alias("ambiguous"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                         "component_id")



def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc() % 7 == 2
    scored = maxent.score_texts(_table(spark, sf_dir, "documents"), training=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.drop("text_key")


OP10_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 items AS (SELECT item_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
    array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
   FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT k FROM windows),
 runs AS (SELECT row, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
   FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
 found AS (SELECT row, i, runs.k, item_id FROM runs JOIN windows USING (k, phrase)),
 hits AS (SELECT row, count(*) AS n_hit FROM (
   SELECT DISTINCT row, unnest(range(i, i + k)) AS p FROM found) GROUP BY row),
 listed AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
   SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN listed USING (row)"""


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    rows = []
    for t in (*licenses.PHRASES, *licenses.NOTICES):
        held = licenses.words(t.text)
        need = licenses.needed(len(set(held)), 1.0 if t.ordered else licenses.THRESHOLD)
        rows.append(f"('{t.label}', {t.ordered}, {t.base}, {held}, {need})")
    return ", ".join(rows)


_STEP = max(len(licenses.words(t.text)) for t in (*licenses.PHRASES, *licenses.NOTICES))

OP11_SQL = rf"""
WITH templates(label, ordered, base, held, need) AS (VALUES {_template_rows()}),
 docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 blocks AS (SELECT row, list_distinct(list_slice(w, b + 1, b + {2 * _STEP})) AS held
   FROM (SELECT row, w, unnest(range(0, len(w), {_STEP})) AS b FROM docs)),
 notices AS (SELECT row, label, max(len(list_intersect(b.held, t.held)) / len(list_distinct(t.held))) AS score
   FROM blocks b, templates t WHERE NOT ordered AND len(list_intersect(b.held, t.held)) >= need
   GROUP BY row, label),
 places AS (SELECT row, label, base, i FROM (SELECT row, label, base, t.held, w,
     unnest(range(0, len(w) - len(t.held) + 1)) AS i FROM docs, templates t
     WHERE ordered AND list_has_all(w, t.held))
   WHERE list_slice(w, i + 1, i + len(held)) = held),
 found AS (SELECT row, label, score, CAST(NULL AS BIGINT) AS i FROM notices
   UNION ALL SELECT row, label, 1e0, CASE WHEN base THEN i END FROM places),
 judged AS (SELECT row, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL) AS base_labels,
   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM docs LEFT JOIN judged USING (row)"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
   SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
   FROM documents)),
 grams AS MATERIALIZED (SELECT lang, d, phrase, count(*) AS f FROM (
   SELECT lang, d, array_to_string(list_slice(w, i, i + d - 1), ' ') AS phrase FROM (
     SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i
     FROM pieces, (VALUES (1), (2), (3), (4)) depths(d) WHERE len(w) >= d)) GROUP BY lang, d, phrase),
 totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE d = 1 GROUP BY lang),
 frequent AS MATERIALIZED (SELECT * FROM grams WHERE f >= 30),
 candidates AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS words, f AS a
   FROM frequent WHERE d > 1),
 parts AS (SELECT DISTINCT lang, a, array_to_string(list_slice(words, i, i + d - 1), ' ') AS phrase FROM (
     SELECT lang, words, a, d, unnest(range(1, len(words) - d + 2)) AS i
     FROM candidates, (VALUES (2), (3)) depths(d) WHERE d < len(words))),
 inside AS MATERIALIZED (SELECT DISTINCT c.lang, c.phrase FROM parts
   JOIN candidates c ON c.lang = parts.lang AND c.phrase = parts.phrase
   WHERE CAST(parts.a AS HUGEINT) * 100 >= CAST(c.a AS HUGEINT) * 80),
 split AS (SELECT lang, phrase, a, k, array_to_string(list_slice(words, 1, k), ' ') AS front,
     array_to_string(list_slice(words, k + 1, len(words)), ' ') AS back
   FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates)
   ANTI JOIN inside USING (lang, phrase)),
 cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
   CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
   FROM split c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.front
   JOIN frequent y ON y.lang = c.lang AND y.phrase = c.back),
 least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
 ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (
     PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
   FROM least WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.alignment(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_tokens": op2_tokens,
    "op3_shards": op3_shards,
    "op4_urls": op4_urls,
    "op5_mix": op5_mix,
    "op6_vectors": op6_vectors,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_maxent": op9_maxent,
    "op10_decontaminate": op10_decontaminate,
    "op11_licenses": op11_licenses,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
   AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
   AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9e0),
 reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id,
  vec_id = component_id AS kept
FROM v JOIN roots ON roots.a = vec_id"""

ORACLES = {
    "op6_vectors": OP6_SQL,
    "op4_urls": OP4_SQL,
    "op5_mix": OP5_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_licenses": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
