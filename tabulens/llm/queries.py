"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm.chat_tree import prefix_tree, read_back
from tabulens.llm.common import read_table
from tabulens.llm.html import main_texts
from tabulens.llm.mixing import mixed
from tabulens.llm.negatives import hard_negatives
from tabulens.llm.packing import pack_documents
from tabulens.llm.periods import periodic_runs, planted
from tabulens.llm.phrases import edited_likeness
from tabulens.llm.pii import private_values
from tabulens.llm.quality import quality_rules
from tabulens.llm.simhash import simhash_components
from tabulens.llm.token_counts import token_counts
from tabulens.llm.toxicity import toxicity
from tabulens.llm.warc import archived_pages
from tabulens.session import scratch_dir


# The pseudonyms of the registered queries; a user keeps a key of their own secret.
KEY = "registered-queries"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_rules(docs, labels)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its private values."""
    return private_values(read_table(spark, sf_dir, "documents"), KEY)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: where and how often each is used."""
    return mixed(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "mix_source", "mix_tokens", "mix_weight", "mix_round", "mix_position"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity(docs, labels).drop("spans")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives in the shared folder and back."""
    return archived_pages(spark, read_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled 32k piece model."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op8_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(read_table(spark, sf_dir, "pages"))


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return edited_likeness(read_table(spark, sf_dir, "documents"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest id it is linked to."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with planted ends, and digests of what collapsing leaves."""
    found = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("before"), (-r.period).alias("finer")))
    best = F.array_max(ranked)
    listed = F.transform(
        "runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    )
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["before"]).alias("start"),
        best["length"].alias("length"),
        (-best["finer"]).alias("period"),
        F.floor(F.lit(1000) * best["length"] / -best["finer"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that spells the template's marks, through the prefix tree and back."""
    marks = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string"
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    told = read_back(prefix_tree(rows, public_tokenizers.path("byte_bpe_50k.tiktoken")))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are one on."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_main_texts": op8_main_texts,
    "op9_phrase_fingerprints": op9_phrase_fingerprints,
    "op10_simhash_components": op10_simhash_components,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_tree": op12_chat_tree,
    "op13_hard_negatives": op13_hard_negatives,
}

ARCHIVED = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
  f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload)"""
# The given pages mark their article, whose blocks SQL can cut out; other pages are left to the tests.
MAIN_TEXTS = r"""WITH a AS (SELECT page_id, url,
    string_split_regex(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' '), '</?(?:p|h1)>') AS parts
  FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(
    regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'),
    '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""
# Digests of the turns as they are, and the characters that the template adds to them.
CHAT = r"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(role, '<\|+', '\0|', 'g')) + length(regexp_replace(text, '<\|+', '\0|', 'g'))
    + length('<|im_start|>' || '<|im_end|>') + 2 AS formatted,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role)) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

ORACLE = {
    "op6_warc": ARCHIVED,
    "op8_main_texts": MAIN_TEXTS,
    "op12_chat_tree": CHAT,
    "op13_hard_negatives": NEGATIVES,
}
