"""The corpus pipeline: reject toxic documents, keep one of each group of near copies, remove repeated passages, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, sentencepiece_fst, simhash, substrings, toxicity
from corpusloom.sources.shared import materialise

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substrings.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", sentencepiece_fst.stage),
]

#: SQL expresses neither the learned scores nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's documents.

    Null and empty texts go through every stage; repeated rows are near copies, of which one stays; a text of any length is one row throughout; an empty
    table gives no rows. Columns beside those of documents stay up to the last stage; names that begin with _tox_, _keep_, _sub_ or _mix_ clash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
