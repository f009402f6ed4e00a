"""Training-data pipeline over ``documents``: each stage's output is written and read again by the next.

Every stage but the last returns the columns of ``documents``; the last adds the ids of the sanitised texts. Stages
work on all that the stage before kept, handle null and empty texts as their operators do, and give no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _jobs, decontam, jaccard, pieces, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier (operator 6) accepts."""
    return quality.filter_documents(docs, quality.fit(docs, _jobs.table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (operator 5): five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark contaminates (operator 3)."""
    return decontam.drop_contaminated(docs, _jobs.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that reveal it, in every text (operator 4)."""
    return pii.sanitise(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text (operator 8): columns ids and n_tokens beside those of ``documents``."""
    return pieces.encode(docs).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's output goes when the next one's has been written."""
    docs, before = _jobs.table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _jobs.written(docs, "snappy")
            _jobs.discard(*before)
            before = [docs]
    return docs
