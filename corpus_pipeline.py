"""A training-corpus pipeline in five stages, each an operator of ``leafpress.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet
in the shared folder, rereads it as the next one's documents, and deletes what came before. All but the last
return the columns of ``documents``. SQL can't express XXH64 fingerprints and the linking of secrets, so
``ORACLE_SQL`` is None and the tests compare with brute force.

Null ids and texts, repeated rows, extra columns of any name and empty tables pass through every stage as its
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafpress.llm import decontaminate, mixing, quality, secrets, simhash
from leafpress.llm.shared import MADE, cut, drop_made, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the others go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8, budget=simhash.WIDE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
            drop_made(spark, before, docs)
    return docs
