"""The training-data pipeline over the documents table: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulens.llm.common import read_table, written
from tabulens.llm.mixing import mixture
from tabulens.llm.near_copies import without_near_copies
from tabulens.llm.packing import pack_documents
from tabulens.llm.pii import pseudonymised
from tabulens.llm.quality import keep_good
from tabulens.llm.simhash import simhash_components

# The pseudonyms of the registered run; a user keeps a key of their own secret.
KEY = "corpus-pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id.

    The groups are the components of SimHash fingerprints, as ``op10_simhash_components`` has them, widened by those of
    longer fingerprints; the exact likeness of the texts then decides.
    """
    return without_near_copies(docs, found=written(simhash_components(docs), "simhash"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values get pseudonyms of the same format."""
    return pseudonymised(docs, KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce sources are repeated as the mixture has them; none goes."""
    return mixture(docs).select("mix_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("pii", pii),
    ("mixing", mix),
    ("packing", pack),
]

# Classifier, fingerprints and tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
