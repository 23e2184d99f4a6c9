"""Where every record stems from: root, depth and the chain of hashes above, by pointer doubling.

A record knows its parent; after each round it knows its ancestors twice as far up, so a chain of n parents takes about
log2(n) joins. A way that comes by a record twice goes in a circle, and is given up in the round that shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scan import Store


def lineage(records: DataFrame, store: Store) -> DataFrame:
    """Adds root, depth, ancestors (hashes, from the parent upwards) and state to terminal records.

    records: source_path (unique), parent_source, source_hash and more. A record without parent is its own root, of depth 0.
    state: ``ok``; ``orphan`` if a parent on the way has no record (root is then the last that has one); ``recursive`` if the
    record's own hash stands above it; ``cycle`` if the way up never ends: root, depth and ancestors are null then. Parents of any
    number of records are met by joins that adaptive execution can split.
    """
    above = records.select(F.col("source_path").alias("up"), F.struct("source_path", "source_hash").alias("one"))
    met = records.select("source_path", F.col("parent_source").alias("up")).join(above, "up", "left")
    none = F.expr("cast(array() as array<struct<source_path:string,source_hash:string>>)")
    found = F.col("one").isNotNull()
    circle = F.col("up") == F.col("source_path")
    end = F.when(F.col("up").isNull(), "root").when(~found, "orphan").when(circle, "cycle")
    steps = store(met.select("source_path", F.when(found, F.array("one")).otherwise(none).alias("chain"), end.alias("end")), "lineage-0")
    turn = 0
    while not steps.where("end is null").isEmpty():
        turn += 1
        far = steps.select(F.concat("source_path", F.lit("")).alias("at"), F.col("chain").alias("rest"), F.col("end").alias("far_end"))  # a key written anew: exchanges that can be split
        going = steps.where("end is null").withColumn("at", F.element_at("chain", -1)["source_path"]).join(far, "at")
        way = F.concat(F.array("source_path"), F.col("chain.source_path"), F.col("rest.source_path"))
        twice = F.size(F.array_distinct(way)) < F.size(way)
        moved = going.select("source_path", F.concat("chain", "rest").alias("chain"), F.when(twice, "cycle").otherwise(F.col("far_end")).alias("end"))
        steps = store(steps.where("end is not null").unionByName(moved), f"lineage-{turn}")
    own = records.join(steps, "source_path")
    hashes = F.col("chain.source_hash")
    round_ = F.col("end") == "cycle"
    state = F.when(round_, "cycle").when(F.coalesce(F.array_contains(hashes, F.col("source_hash")), F.lit(False)), "recursive").when(F.col("end") == "orphan", "orphan").otherwise("ok")
    root = F.when(F.size("chain") > 0, F.element_at("chain", -1)["source_path"]).otherwise(F.col("source_path"))
    shown = {"root": F.when(~round_, root), "depth": F.when(~round_, F.size("chain").cast("long")), "ancestors": F.when(~round_, hashes), "state": state}
    return own.select(*records.columns, *(c.alias(n) for n, c in shown.items()))
