"""From converted contents to one outcome per source: who is written, who borrows, who fails.

A content's text is made once. Which sources get it is settled by their place in the walk: a source whose artifact's place
is taken is not written, and only a text that was written is one that others borrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import dedup
from quillspark.operators.manifest import ancestor_prefixes
from quillspark.operators.scan import Store

#: What an artifact's files add to the name of their source.
ENDINGS = (".txt", ".segments.jsonl")


def place_conflicts(rows: DataFrame) -> DataFrame:
    """(early, late): sources of which one's artifact is a file where the other's needs a folder, by their order.

    rows: source_path, ord. Both are found from the one below: only folders that end like an artifact can be taken, so what is
    joined is small however many rows there are.
    """
    named = F.filter(ancestor_prefixes(F.col("source_path")), lambda p: (p != F.col("source_path")) & F.exists(F.array(*map(F.lit, ENDINGS)), lambda e: F.endswith(p, e)))
    below = rows.select(F.col("source_path").alias("user"), F.col("ord").alias("user_ord"), F.explode(named).alias("folder"))
    owner = F.regexp_replace("folder", r"\.(txt|segments\.jsonl)$", "")
    owners = rows.select(F.col("source_path").alias("owner"), F.col("ord").alias("owner_ord"))
    met = below.withColumn("owner", owner).join(owners, "owner")
    first = F.col("owner_ord") < F.col("user_ord")
    return met.select(F.when(first, F.col("owner")).otherwise(F.col("user")).alias("early"), F.when(first, F.col("user")).otherwise(F.col("owner")).alias("late")).distinct()


def blocked(rows: DataFrame, store: Store) -> DataFrame:
    """source_path of the rows that are not written because an earlier row is.

    A row is written unless an earlier written row stands in its way. Each round settles the rows that have no earlier one
    left in theirs; there are as many rounds as conflicts stand above each other, none without conflicts. ``store`` keeps a
    frame under a name beyond its lineage.
    """
    open_, out, turn = store(place_conflicts(rows), "conflicts"), None, 0
    while not open_.isEmpty():
        turn += 1
        late = open_.select(F.col("late").alias("early"))
        losing = store(open_.join(late, "early", "left_anti").select(F.col("late").alias("source_path")).distinct(), f"blocked-{turn}")
        out = losing if out is None else out.unionByName(losing)
        for side in ("early", "late"):
            open_ = open_.join(losing.withColumnRenamed("source_path", side), side, "left_anti")
        open_ = store(open_, f"conflicts-{turn}")
    return out if out is not None else rows.select("source_path").limit(0)


def assigned(rows: DataFrame, seeds: DataFrame, store: Store) -> DataFrame:
    """Adds status and dedup_of to fresh convertible rows; what failed or wasn't written fills no slot.

    rows: source_hash, source_path, ord, converter (that the source goes to), recorded (that made the content's text; null if there is none),
    taken (what keeps it from being written, or null). seeds: source_hash, source_path, converter of intact earlier artifacts.
    A text that another converter than the routed one made, as when it was only recovered, is no one's to borrow.
    """
    bears = F.col("recorded").isNotNull() & F.col("taken").isNull()
    settled = dedup.seeded(rows.where(bears), seeds, store)
    own = F.col("recorded") == F.col("converter")
    shown = settled.withColumn("status", F.when(own, F.col("status")).otherwise("converted")).withColumn("dedup_of", F.when(own, F.col("dedup_of")))
    lost = rows.where(~bears).withColumn("dedup_of", F.lit(None).cast("string")).withColumn("status", F.lit("failed"))
    return shown.unionByName(lost)


def carriers(rows: DataFrame, *key: str) -> DataFrame:
    """The first row in order of each content: the one that its bytes are read from. By partial minima, whatever number of rows hold a content."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*key, "r.*")


def children(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each child of each source: what is found beside a content belongs to every source that has the content.

    leaves: source_hash, key, source_path and more; found: source_hash, key, suffix and the child's outcome. The child's path is its
    parent's with the suffix, its parent_source the parent.
    """
    met = leaves.drop("parent_source").join(found, ["source_hash", "key"])
    return met.withColumn("parent_source", F.col("source_path")).withColumn("source_path", F.concat("source_path", "suffix"))


def order_of(path: Column, nth: Column) -> Column:
    """The place of a unit: its root's place in the walk, then its own among the root's units."""
    return F.struct(path.alias("root"), nth.cast("int").alias("nth"))
