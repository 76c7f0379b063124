"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret removal, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes every stage's result as
Parquet in the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattis.llm import bpe, decontamination, minhash, quality, secrets
from lattis.llm.common import stored, table

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", minhash.stage),
    ("decontamination", decontamination.stage),
    ("secret scan", secrets.stage),
    ("byte-level BPE", bpe.stage),
]

#: The adaptive fences, edit matching and the transducer can't be written as one SQL query; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
