"""The queries of the numbered operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, exact_dedup, fingerprints, jaccard_join, lm_scoring, packing, prefix_trie, substring_dedup, token_alignment, token_counts, token_files, toxicity, warc
from plumbline.llm.common import shared_path


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """The model of the labelled documents that aren't held out."""
    labels = _table(spark, sf_dir, "labels")
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels.where(~toxicity.held_out()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_model(spark, sf_dir).score(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = token_files.write_token_files(_table(spark, sf_dir, "documents"), shared_path(spark, "token-files"), word_tokenizer(), end_id=2)
    return token_files.read_token_files(spark, parts)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(_table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return warc.read_warc(index).select(F.col("doc_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)
    return packing.with_crc(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(_table(spark, sf_dir, "documents"), word_tokenizer())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents")).drop("version")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.link_statistics(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Equal payloads by their text; base32 of each 20 bits (5 hexadecimal digits) of the digest as 4 letters.
_OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_LETTERS}234567', (((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d"""

#: Two sets that link share one of each one's n - ceil(0.9 n) + 1 rarest shingles; those pairs are counted in full.
_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS place FROM e JOIN f USING (g)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.place <= a.n - (9 * a.n + 9) // 10 + 1 AND b.place <= b.n - (9 * b.n + 9) // 10 + 1 AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
i AS (SELECT a, b, na, nb, len(list_intersect(x.s, y.s)) AS common FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
l AS (SELECT a, b FROM i WHERE 100 * common >= 90 * (na + nb - common)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id)
SELECT s.doc_id, len(s) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""

#: crc32 of the decimal id byte by byte, bit by bit (the polynomial is a fixed value); prefixes as lists of turns.
_OP12 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM t),
h AS (SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_transform(range(0, len(s) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ord(s[i]) END),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(0, 8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM i),
r AS (SELECT c, n AS place, r, t FROM h JOIN t ON conv_id = base AND n <= h UNION ALL SELECT c, n + 8, r, t FROM h JOIN t ON conv_id = c AND n > h),
s AS (SELECT c, coalesce(list({'r': r, 't': t} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS turns FROM h LEFT JOIN r USING (c) GROUP BY c),
n AS (SELECT c, d, turns[1:d] AS p, d = len(turns) AS ends FROM s, unnest(range(0, len(turns) + 1)) AS u(d)),
g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM n GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
b AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN g.d = 0 THEN 0 ELSE strlen(g.p[g.d].t) END AS own FROM g LEFT JOIN k ON k.p = g.p AND k.d = g.d),
x AS (SELECT p[1:e] AS p, e AS d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM b, unnest(range(0, d + 1)) AS u(e) GROUP BY 1, 2)
SELECT b.conv_id, b.d AS depth, a.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, sha256(b.ends) AS ends_sha256
FROM b JOIN x ON x.p = b.p AND x.d = b.d LEFT JOIN g a ON b.d > 0 AND a.d = b.d - 1 AND a.p = b.p[1:b.d - 1]"""

#: Equal texts by the texts themselves.
_OP13 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM t WINDOW same AS (PARTITION BY t)"""

ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op4_jaccard_join": _OP4, "op12_prefix_trie": _OP12, "op13_exact_dedup": _OP13}
