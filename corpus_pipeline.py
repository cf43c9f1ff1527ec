"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm.common import read, stored
from veilmark.llm.mixing import mixing_stage
from veilmark.llm.neardup import neardup_stage
from veilmark.llm.packing import packing_stage
from veilmark.llm.quality import quality_stage
from veilmark.llm.sanitize import sanitize_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", neardup_stage),
    ("personal data", sanitize_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# SQL expresses neither the line labels nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
