"""Relational steps of packing, verifying and merging bundles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import manifest

#: Files that may stand beside a source's artifact.
ENDINGS = (".txt", ".segments.jsonl", ".review.md")


def artifact_states(records: DataFrame, tree: DataFrame) -> DataFrame:
    """source_path, text_path and state (ok, missing, differs) of each record with text; tree: path, hash."""
    files = tree.select(F.col("path").alias("text_path"), F.col("hash").alias("_found"))
    joined = records.where("text_path is not null").join(files, "text_path", "left")
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("text_hash"), "differs").otherwise("ok")
    return joined.select("source_path", "text_path", state.alias("state"))


def unreferenced(tree: DataFrame, records: DataFrame) -> DataFrame:
    """The files of a tree (path) that belong to no record with text."""
    stem = F.regexp_replace("text_path", r"\.txt$", "")
    wanted = records.where("text_path is not null").select(F.explode(F.array(*(F.concat(stem, F.lit(e)) for e in ENDINGS))).alias("path"))
    return tree.join(wanted, "path", "left_anti")


def misplaced(records: DataFrame) -> DataFrame:
    """Records whose text path is not the one that their division and source give."""
    right = (F.col("text_path") == T.mirror_path(F.col("division"), F.col("source_path"))) & T.is_recorded_path(F.col("text_path"))
    return records.where(F.col("text_path").isNotNull() & ~right)


def merged(parts: list[DataFrame]) -> DataFrame:
    """The distinct rows of several lists."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def rules_agreement(snapshots: DataFrame, *by: str) -> DataFrame:
    """Whether all rules snapshots (hash) are the same bytes, for each group if asked."""
    return snapshots.groupBy(*by).agg(F.countDistinct("hash").alias("versions"), (F.countDistinct("hash") == 1).alias("agree"))


def folded_collisions(names: DataFrame) -> DataFrame:
    """Names (name, one row for each input that has it) that fall together when ASCII case is folded."""
    keyed = names.groupBy(T.ascii_lower(F.col("name")).alias("fold")).agg(F.count(F.lit(1)).alias("inputs"), F.sort_array(F.collect_set("name")).alias("names"))
    return keyed.where("inputs > 1")


def counts_and_coverage(records: DataFrame) -> DataFrame:
    """Per division: how many records of each status, and how many terminal ones there are and have text."""
    covered = manifest.terminal(records).groupBy("division").agg(F.count_if(manifest.has_text(F.col("status"))).alias("covered"), F.count(F.lit(1)).alias("sources"))
    return manifest.status_counts(records, "division").join(covered, "division")


def disorder(rows: DataFrame, column: str) -> DataFrame:
    """part, first, last, good: whether a column strictly rises within each partition, and between which values.

    The rows stay as they are dealt out, so a file that was read in order is judged in order; one row for a partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        good, part = True, 0
        for batch in batches:
            if not len(batch):
                continue
            values = [v.encode() for v in batch[column]]
            part = int(batch["part"].iloc[0])
            good = good and all(a < b for a, b in zip(values, values[1:])) and (last is None or last < values[0])
            first, last = values[0] if first is None else first, values[-1]
        if first is not None:
            yield pd.DataFrame({"part": [part], "first": [first.decode()], "last": [last.decode()], "good": [good]})

    return rows.select(column, F.spark_partition_id().alias("part")).mapInPandas(run, "part int, first string, last string, good boolean")


def is_rising(rows: DataFrame, column: str) -> bool:
    """Whether a column strictly rises over all partitions, by bytes; the driver sees one row for each."""
    parts = sorted(disorder(rows, column).collect(), key=lambda r: r.part)
    return all(r.good for r in parts) and all(a.last.encode() < b.first.encode() for a, b in zip(parts, parts[1:]))
