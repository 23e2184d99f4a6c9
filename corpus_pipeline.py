"""A corpus pipeline: toxic documents go, repeated lines go, near copies go, leaked benchmarks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm.common import remove, scratch, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_jaccard", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_leaks),
    ("packing", stages.pack),
]

#: The stages learn a model and search by random splits, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again by the next.

    A stage's table is deleted as soon as the next stands; the last is what comes back.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
