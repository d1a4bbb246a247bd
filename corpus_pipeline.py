"""From raw documents to a training mixture: STAGES in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns of
``documents``; the last adds ``size`` and ``taken``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentiloom.llm.decontamination import decontaminate
from sentiloom.llm.line_dedup import dedup_lines
from sentiloom.llm.mixing import mix_sources
from sentiloom.llm.near_duplicates import keep_one
from sentiloom.llm.toxicity import drop_toxic
from sentiloom.session import scratch_path

STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The toxicity model and the seeded mixture have no SQL form; tests/llm/test_pipeline.py checks every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
