"""Convert once per content: which source is converted and which borrows its text.

Nearly every content goes to one converter wherever it stands, and is settled by one partial aggregation and a join whose
hot keys adaptive execution can split. Only contents that several converters take are put in order, by a segmented scan
that deals a content of any number of sources to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scan import Scan, Store


def dedup_islands(rows: DataFrame, store: Store) -> DataFrame:
    """Adds status and dedup_of to convertible leaf rows (source_hash, ord, source_path, converter).

    A hash has one slot that the last conversion fills. In walk order a row borrows if the slot's converter, which is
    that of the row before it, is its own; else it converts and starts an island, named by its first path.
    """
    none = rows.select("source_hash", "source_path", "converter").limit(0)
    return seeded(rows, none, store)


def one_converter(rows: DataFrame) -> DataFrame:
    """As :func:`dedup_islands` where all rows go to one converter: the first in order converts, the others borrow."""
    first = rows.groupBy("source_hash").agg(F.min_by("source_path", "ord").alias("_owner"))
    met = rows.join(first.withColumn("source_hash", F.concat("source_hash", F.lit(""))), "source_hash")
    borrows = F.col("source_path") != F.col("_owner")
    return met.withColumn("dedup_of", F.when(borrows, F.col("_owner"))).withColumn("status", F.when(borrows, "dedup").otherwise("converted")).drop("_owner")


def seeded(rows: DataFrame, prior: DataFrame, store: Store) -> DataFrame:
    """As :func:`dedup_islands`, with slots first filled from prior terminal records.

    prior: source_hash, source_path, converter of eligible records; the smallest path of a hash fills its slot. A row
    whose own path fills the slot converts, and starts an island.
    """
    seeds = prior.groupBy("source_hash").agg(F.min_by(F.struct("source_path", "converter"), "source_path").alias("seed"))
    contents = rows.groupBy("source_hash").agg(F.min_by("source_path", "ord").alias("first"), F.min("converter").alias("low"), F.max("converter").alias("high"))
    known = contents.join(seeds, "source_hash", "left")
    single = (F.col("low") == F.col("high")) & (F.col("seed").isNull() | (F.col("seed.converter") == F.col("low")))
    owner = F.coalesce("seed.source_path", "first")
    # the key is written anew so that the join below gets exchanges of its own, which can be split
    slots = known.select(F.concat("source_hash", F.lit("")).alias("source_hash"), F.when(single, owner).alias("_owner"), "seed")
    met = rows.join(slots, "source_hash")
    alone = met.where("_owner is not null")
    borrows = F.col("source_path") != F.col("_owner")
    settled = alone.select(*(F.col(c) for c in rows.columns), F.when(borrows, F.col("_owner")).alias("dedup_of"), F.when(borrows, "dedup").otherwise("converted").alias("status"))
    return settled.unionByName(_in_order(met.where("_owner is null").drop("_owner"), store))


def _in_order(rows: DataFrame, store: Store) -> DataFrame:
    """Contents of several converters, row by row; rows carry their hash's seed."""
    scan = Scan(rows, ["source_hash"], ["ord"], store, "islands").lag("_before", F.col("converter"))
    own = F.coalesce(F.col("seed.source_path") == F.col("source_path"), F.lit(False))
    borrows = F.coalesce(F.coalesce("_before", "seed.converter") == F.col("converter"), F.lit(False)) & ~own
    named = scan.last("_start", F.when(~borrows, F.col("source_path"))).rows
    canonical = F.coalesce("_start", "seed.source_path")
    done = named.withColumn("dedup_of", F.when(borrows, canonical)).withColumn("status", F.when(borrows, "dedup").otherwise("converted"))
    return done.drop("seed", "_before", "_start")


def content_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Sources and distinct contents of each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), F.countDistinct("source_hash").alias("contents"))
