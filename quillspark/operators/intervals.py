"""Which ranges contain a point, by an equi-join of dyadic cells.

A range of whole numbers is cut into cells of the form [i * 2**level, (i + 1) * 2**level), at most two for each level; a
point lies in one cell of each level. A point and a range meet in exactly one cell if the range contains the point, in none
otherwise, so no pair is compared that doesn't belong to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that ranges may hold: 0 to 2**LEVELS - 1; what of a range lies outside is cut off.
LEVELS = 62
#: Cells of all ranges that are broadcast, at most: so few may hold any share of the points each, which then aren't shuffled by them.
FEW = 10_000


def cells(first: Column, last: Column) -> Column:
    """The cells (level, at) of a range, both ends included; none if it is empty."""
    low = F.greatest(first.cast("long"), F.lit(0))
    high = F.least(last.cast("long"), F.lit((1 << LEVELS) - 1)) + 1
    none = F.expr("cast(array() as array<struct<level:int,at:bigint>>)")
    start = F.struct(low.alias("a"), high.alias("b"), none.alias("out"))

    def cut(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        rest_a = F.when(odd_a, a + 1).otherwise(a)
        twice = odd_b & (rest_a < b)  # else both ends are the one cell taken already
        rest_b = F.when(twice, b - 1).otherwise(b)
        mine = F.when(odd_a, F.array(F.struct(level.alias("level"), a.alias("at")))).otherwise(none)
        other = F.when(twice, F.array(F.struct(level.alias("level"), (b - 1).alias("at")))).otherwise(none)
        more = rest_a < rest_b
        half = lambda c: F.when(more, F.shiftright(c, 1)).otherwise(0).cast("long")
        return F.struct(half(rest_a).alias("a"), half(rest_b).alias("b"), F.concat(state["out"], mine, other).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, cut, lambda state: state["out"])


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Each point with each range of its keys that contains it; ranges: keys, first, last and more columns.

    Points below 0, and null points or ends, meet nothing. Only levels that some range has are looked up.
    """
    cut = ranges.where("first <= last and last >= 0").withColumn("_cell", F.explode(cells(F.col("first"), F.col("last")))).select("*", F.col("_cell.level").alias("_level"), F.col("_cell.at").alias("_at")).drop("_cell")
    found = {r["_level"]: r["count"] for r in cut.groupBy("_level").count().collect()}  # at most LEVELS + 1
    used, few = sorted(found), sum(found.values()) <= FEW
    level = F.explode(F.lit(used).cast("array<int>"))
    placed = points.where(F.col(point) >= 0).withColumn("_level", level).withColumn("_at", F.expr(f"shiftright(cast(`{point}` as bigint), _level)"))
    return placed.join(F.broadcast(cut) if few else cut, [*keys, "_level", "_at"]).drop("_level", "_at")
