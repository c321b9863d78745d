"""Documents to training tokens: each stage applies one operator's decisions to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import op3_minhash_dedup as op3
from postmill.llm import op5_quality_rules as op5
from postmill.llm import op6_byte_bpe as op6
from postmill.llm import op8_decontamination as op8
from postmill.llm import op10_secret_scan as op10
from postmill.llm.common import saved

#: Each takes (spark, docs, sf_dir); all but the last return the columns of docs.
STAGES = [
    ("quality_rules", op5.stage),
    ("minhash_near_dedup", op3.stage),
    ("benchmark_decontamination", op8.stage),
    ("secret_scans", op10.stage),
    ("byte_level_bpe", op6.stage),
]

#: Stages use Arrow batches and iteration; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
