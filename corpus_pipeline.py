"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return the documents
that go on, written as Parquet and read again in between. The last one returns packed pieces.

Cases: see the operators; a stage works on all that its predecessor kept, and all but the
last return the columns of ``documents`` in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import exact, packing, rules, secrets, simhash
from souk.llm.common import save, table
from souk.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, shingle=3, radius=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text."""
    return secrets.redact_documents(docs, secrets.new_ledger(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, with their ids."""
    return packing.pack(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

# Learned thresholds, hashing by XXH64 and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
