"""From raw documents to token ids: five stages, each one operator, with a table between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm import mixing, pii, quality_rules, sentencepiece, simhash
from proxigraph.plans.session import table
from proxigraph.plans.shared import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def free_prefix(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` has."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: by files, then by rows of a file."""
    prefix = free_prefix(docs)
    mixed, at = mixing.mix(docs, prefix=prefix), f"{prefix}position"
    return mixed.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    out = sentencepiece.encode(docs, keep=["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", rules), ("simhash", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("sentencepiece", tokens)]

#: SimHash, the patterns' spans and the pieces are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
