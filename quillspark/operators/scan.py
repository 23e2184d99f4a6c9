"""Running values within keys by a segmented prefix scan: no key is ever one task.

Rows are dealt in ranges of (key, order) and stored with the number of their range. A range is reduced to a summary of its
first and its last key, the only ones that can go on in other ranges; summaries are composed in order, and each range is
finished with what its first key brings along. So one key may hold all rows, and many tasks still share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Store = Callable[[DataFrame, str], DataFrame]


class Scan:
    """Rows in order within keys; each call adds a column of running values. ``rows`` gives them back.

    ``store`` keeps a frame beyond its lineage: ranges must not be drawn anew for each use. Null keys are a key of their own;
    rows of equal order stand in any order.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], store: Store, name: str = "scan"):
        self.columns = list(rows.columns)
        key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
        marked = rows.withColumn("_key", key).withColumn("_ord", F.struct(*order))
        self._all = store(marked.repartitionByRange("_key", "_ord").withColumn("_part", F.spark_partition_id()), name)
        ends = self._all.groupBy("_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
        self._ends = F.broadcast(ends)  # one row for each range

    @property
    def rows(self) -> DataFrame:
        return self._all.select(*self.columns)

    def _within(self) -> Window:
        return Window.partitionBy("_part", "_key").orderBy("_ord")

    def _carried(self, summary: Column, compose: Callable[[Column], Column]) -> DataFrame:
        """(_part, _key, _carry) for the keys that several ranges hold: at most two for a range."""
        at_ends = self._all.join(self._ends, "_part").where((F.col("_key") == F.col("_low")) | (F.col("_key") == F.col("_high")))
        each = at_ends.groupBy("_part", "_key").agg(summary.alias("_sum"))
        before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        return each.select("_part", "_key", compose(F.col("_sum")).over(before).alias("_carry")).where("_carry is not null")

    def _add(self, name: str, local: Column, carry: DataFrame, join: Callable[[Column, Column], Column]) -> Scan:
        # the local value is worked out before the join, which moves no row of this side
        met = self._all.withColumn("_local", local).join(F.broadcast(carry), ["_part", "_key"], "left")
        self._all = met.withColumn(name, join(F.col("_local"), F.col("_carry"))).drop("_local", "_carry")
        self.columns = [c for c in self.columns if c != name] + [name]
        return self

    def sum(self, name: str, value: Column) -> Scan:
        """The sum of ``value`` over the key's rows up to and with each row."""
        local = F.sum(value).over(self._within().rowsBetween(Window.unboundedPreceding, 0))
        return self._add(name, local, self._carried(F.sum(value), F.sum), lambda mine, carry: mine + F.coalesce(carry, F.lit(0)))

    def lag(self, name: str, value: Column) -> Scan:
        """``value`` in the row before, null in a key's first row."""
        local = F.struct(F.row_number().over(self._within()).alias("n"), F.lag(value).over(self._within()).alias("v"))
        carry = self._carried(F.max_by(F.struct(value.alias("v")), F.col("_ord")), lambda s: F.last(s))
        return self._add(name, local, carry, lambda mine, far: F.when(mine["n"] == 1, far["v"]).otherwise(mine["v"]))

    def last(self, name: str, value: Column) -> Scan:
        """The last ``value`` that is not null, up to and with each row."""
        local = F.last(value, ignorenulls=True).over(self._within().rowsBetween(Window.unboundedPreceding, 0))
        carry = self._carried(F.max_by(value, F.when(value.isNotNull(), F.col("_ord"))), lambda s: F.last(s, ignorenulls=True))
        return self._add(name, local, carry, lambda mine, far: F.coalesce(mine, far))
