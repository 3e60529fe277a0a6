"""The corpus pipeline: languages, near-duplicates, the mix of sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm.language_id import keep_known
from gridspark.llm.mixing import in_mixed_order
from gridspark.llm.near_dedup import keep_one
from gridspark.llm.sentencepiece_codec import tokenise
from gridspark.plans.lineage import cut

STAGES = [
    ("language id", keep_known),
    ("near dedup", keep_one),
    ("mixing", in_mixed_order),
    ("sentencepiece", tokenise),
]

ORACLE_SQL = None
"""Language id, near dedup and encoding are not SQL; tests/llm/test_operators.py compares with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between two stages rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
