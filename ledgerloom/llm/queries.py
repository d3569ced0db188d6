"""The registered queries of the training-data operators and, where DuckDB can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import align, decontam, jaccard, knn, langid, linededup, packing, pseudonym, quality, simhash, spelling, tokencount, tokenfile
from ledgerloom.llm._common import crc_bucket, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", F.col("n_words").cast("long"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfile.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonym.pseudonymise(docs, "a-key-of-the-caller").select("doc_id", "text", "n_values", "changed")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = (crc_bucket("doc_id", 5) == 0).alias("held_out")
    model = quality.fit(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    return quality.scored(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = docs.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    model = langid.fit(langid.learnable(docs))
    return langid.predicted(held_out, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = align.align_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), shingle=3, similarity=0.9).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_packing, op4_token_counts, op5_pseudonyms, op6_nearest_neighbours, op7_line_dedup, op8_simhash, op9_quality, op10_language_id, op11_alignment, op12_spelling, op13_jaccard)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = r"[ \t\r\f\x0B]"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(s) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, len(w) - k + 2)) t(s)),
h AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
p AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM h, unnest(range(0, k)) u(o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op7_line_dedup": rf"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
m AS (SELECT doc_id, no, line, regexp_replace(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[^ \t\r\f\x0B]*[0-9][^ \t\r\f\x0B]*', '<*>', 'g') AS masked FROM l),
t AS (SELECT *, string_split_regex(masked, '{_SPACE}+') AS tok FROM m WHERE masked <> ''),
k AS (
  SELECT doc_id, no, len(tok) || '|-1|' || array_to_string(tok, ' ') AS template FROM t
  UNION ALL
  SELECT doc_id, no, len(tok) || '|' || j || '|' || array_to_string(tok[1:lo], ' ') || '|' || array_to_string(tok[hi + 1:len(tok)], ' ')
  FROM (SELECT *, CASE j WHEN 0 THEN 2 ELSE len(tok) * j // 4 END AS lo, len(tok) * (j + 1) // 4 AS hi FROM t, range(4) r(j) WHERE len(tok) >= 8) WHERE hi > lo),
r AS (SELECT template, min(doc_id) AS first_id FROM k GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT DISTINCT k.doc_id, k.no FROM k JOIN r ON k.template = r.template WHERE k.doc_id <> first_id),
c AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL), '') AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN kept ELSE text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id""",
}
