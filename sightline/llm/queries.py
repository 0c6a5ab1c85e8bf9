"""The registered query of each operator, with its parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, htmltext, langid, merkle, mixing, negatives, packing, quality, simhash, substrings, tokencounts, tokenfiles
from .common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows
), gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS g FROM ranked, unnest(range(0, 20)) AS t(j) WHERE n > 1 GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(g, i)), lambda i: ws[i]) END AS ks
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    width = tokenfiles.width_of(path)
    ids = tokenfiles.tokenize(read_table(spark, sf_dir, "documents"), path, end_id=49407, width=width)
    return tokencounts.count_tokens(ids, end_id=49407, width=width)


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.to_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfiles.with_crc32(tokenfiles.read_token_files(spark, path))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS t(i)
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM counted, unnest(range(0, 8)) AS t(j) WHERE counted.n > 1 GROUP BY doc_id
), base AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS capitals,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare
  FROM w LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (5 * n_symbols > n_words OR 2 * capitals > word_chars OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * bare > 4 * n_words) AS kept
FROM judged
"""


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n ON a = vec_id
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), codec)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.with_crc32(pieces))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid AS au, a.vec_id AS anchor_id, b.uid AS bu, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.au, p.bu ORDER BY n.score DESC, n.id)::INT AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.au = p.au AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score
)
SELECT * FROM ranked WHERE rank <= 5
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_chars, doc = F.col("n_chars").cast("decimal(20,0)"), F.col("doc_id").cast("string")
    leaf = lambda n: merkle.row_leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when(F.crc32(doc.cast("binary")) % 7 == 0, leaf(n_chars + 1))
    leaves = read_table(spark, sf_dir, "documents").select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), tampered.alias("tampered"))
    proven = merkle.manifest(leaves, "lang", "doc_id", "leaf")
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END) AS crc
  FROM documents
), fields AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, xor(crc, 4294967295::UBIGINT) % 7 = 0 AS tampered
  FROM docs
), leaves AS (
  SELECT doc_id, lang, i, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM fields
), nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2
), subroots AS (
  SELECT lang, level AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM nodes WHERE n = 1
), uppers(level, i, h, n) AS (
  SELECT 0, g, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM uppers WHERE n > 1 GROUP BY level, i // 2
), steps AS (
  SELECT l.doc_id, l.lang, l.i AS pos, v.level AS step, l.i >> v.level AS own, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, unnest(range(0, r.top)) AS v(level)
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = v.level AND s.i = xor(l.i >> v.level, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, l.i, r.top + v.level, r.g >> v.level, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT level FROM uppers WHERE n > 1) AS v
  LEFT JOIN uppers s ON s.level = v.level AND s.i = xor(r.g >> v.level, 1)
), folded(lang, pos, step, h) AS (
  SELECT lang, i, 0, coalesce(other, leaf) FROM leaves
  UNION ALL
  SELECT f.lang, f.pos, f.step + 1, sha256(CASE WHEN s.own % 2 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.step = f.step
), ends AS (SELECT lang, pos, arg_max(h, step) AS folded_root FROM folded GROUP BY lang, pos),
proof AS (SELECT lang, pos, string_agg(coalesce(h, ''), '' ORDER BY step) AS p FROM steps GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.i
  LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.i, (SELECT h FROM uppers WHERE n = 1) AS t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_substring_dedup,
        op3_language_id,
        op4_token_counts,
        op5_token_id_files,
        op6_quality_rules,
        op7_mix_sources,
        op8_html_text,
        op9_embedding_near_dedup,
        op10_byte_bpe,
        op11_best_fit_packing,
        op12_hard_negatives,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op6_quality_rules": OP6_SQL, "op9_embedding_near_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
