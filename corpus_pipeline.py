"""A corpus in five stages: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes all that the one before kept. All but the last return the
columns of ``documents``. Between stages the rows are written and read again, and
what a stage wrote on the way is deleted.

Null texts count as empty and fail the quality rules. Rows without doc_id go
through all stages; equal texts of theirs are copies. Repeated rows are copies too,
so one stays. Ties are broken by doc_id, then by the text, in every stage; rows equal in both are one and the same. Very long texts are read whole by every stage. Extra columns, whatever
their names, travel on to the last stage, which returns places in batches. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracurve.llm import copies, mixing, packing, quality, secret_scan, simhash
from terracurve.llm.common import settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; each text is measured once."""
    return quality.kept(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash fingerprints and covering masks, verified at 0.8 of
    their five-word shingles. The smallest doc_id of a group stays, rows without one last."""
    return simhash.first_of_each(docs, copies.near_copies(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; what the session's ledger knows isn't scanned again."""
    return secret_scan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, in the order of the schedule."""
    return mixing.resampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document, copies that the mix added included, in the token-budget batches."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the near-duplicate stage; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
