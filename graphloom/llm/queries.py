"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import fingerprint, langid, licences, linededup, lm, mixing, negatives, ngram_join, packing, pieces, quality, tokencount, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id, folds: int):
    """crc32 of doc_id as text, mod ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_report(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", *quality.SIGNALS, "base_failed", "kept", "quality_prob")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_sections(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_segments", "licences", "best_licence", "best_dice")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.rebuilt).drop("n_ends")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(negatives.digitised(table(spark, sf_dir, "embeddings"), label), every=50)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_packing,
        op3_ngram_join,
        op4_pitman_yor,
        op5_line_dedup,
        op6_fingerprints,
        op7_language_id,
        op8_quality_rules,
        op9_token_counts,
        op10_license_scan,
        op11_prefix_trie,
        op12_hard_negatives,
        op13_sentencepiece,
    )
}

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: Bit by bit, since DuckDB has no function of this name.
CRC32 = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT), lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: xor(v >> 1, (v & 1) * 3988292384)), 4294967295), 4294967295)"

#: SQL is given where it can express a query on whole tables.
SQL: dict[str, str] = {
    "op1_source_mix": rf"""WITH s AS (SELECT doc_id, source, CAST(coalesce(len({WORDS.format("text")}), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM s GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM s)::DOUBLE AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
q AS (SELECT s.doc_id, s.size, t.*, k, CAST('0x' || left(md5('17|' || k || '|' || s.doc_id), 15) AS BIGINT) AS place FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) x(k)),
f AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM q),
h AS (SELECT *, least(64 * (j + 1), size) - 64 * j AS words, CASE WHEN target > 0 THEN (start + least(64 * (j + 1), size)) / target END AS finish FROM (SELECT *, unnest(range(0, greatest((size + 63) // 64, 1))) AS j FROM f)),
g AS (SELECT *, sum(words) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, k, place, doc_id, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM h)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(words, CAST(floor(1.5 * (SELECT sum(size) FROM s)) AS BIGINT) - before))) AS BIGINT) AS taken FROM g GROUP BY doc_id, size, source_size, target""",
    "op3_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({WORDS.format(LOWERED)}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS m FROM w UNION SELECT u.b, r.m FROM r JOIN u ON r.v = u.a),
k AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY h) END AS class_id FROM (SELECT w.doc_id, w, coalesce(h, '') AS h FROM w LEFT JOIN (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS h FROM g GROUP BY doc_id) USING (doc_id)))
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, class_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(m) AS c FROM r GROUP BY v) ON v = w.doc_id JOIN k ON k.doc_id = w.doc_id""",
    "op5_line_dedup": r"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(doc_id <> owner, FALSE) AS dropped FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INTEGER) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op11_prefix_trie": rf"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS j, m, len({WORDS.format("text")}) AS w
  FROM (SELECT conv_id, turn, text, md5(length(role) || ':' || role || text) AS m FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
k AS (SELECT c, count(*) AS n, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM t GROUP BY c),
g AS (SELECT k.c, k.h, least(k.h, coalesce(b.n, 0)) AS p FROM k LEFT JOIN k b ON b.c = k.c - k.c % 20),
r AS (SELECT t.c, j - h + p + 1 AS d, m, w FROM t JOIN g USING (c) WHERE j >= h UNION ALL SELECT g.c, j + 1, m, w FROM g JOIN t ON t.c = g.c - g.c % 20 WHERE j < g.h),
p AS (SELECT c, d, w, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM g),
n AS (SELECT key, d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM p GROUP BY key, d),
k2 AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k2 USING (key)),
s AS (SELECT left(key, 32 * i) AS key, CAST(sum((kids = 0)::INTEGER) AS BIGINT) AS leaves, CAST(sum((n - 1) * w) AS BIGINT) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1),
e AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(key, d) AS key FROM p GROUP BY c) GROUP BY key)
SELECT f.c AS conv_id, f.d AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (key) LEFT JOIN n u ON f.d > 0 AND u.key = left(f.key, 32 * (f.d - 1)) LEFT JOIN e ON e.key = f.key""",
    "op12_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS n FROM s WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
}
