"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, personal data are masked,
sources are mixed to their targets and the texts are coded. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import jaccard, mixing, pieces, pii, toxicity
from folioframe.llm.common import Scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard", jaccard.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]
#: Trained models, drawn copies and token codes have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
