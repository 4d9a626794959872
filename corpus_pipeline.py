"""From raw documents to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import stages
from sparkloom.llm.common import made, stored, sweep

STAGES = [
    ("quality classifier", stages.keep_good),
    ("line dedup", stages.drop_lines),
    ("MinHash near-dedup", stages.drop_copies),
    ("suffix-array dedup", stages.drop_repeats),
    ("best-fit packing", stages.pack),
]

#: A fitted net and suffix arrays have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is stored as Parquet and read again, and what a
    stage and the one before it had stored then goes."""
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
            sweep(spark, (*others, made()[-1]))
    return docs
