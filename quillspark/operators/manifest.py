"""The manifest's algebra: every relational step over records of outcomes.

A shard is a frame with at least (division, source_path, line_no, status); its order within a division is line_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import bundle_collision_key, run_collision_key
from quillspark.operators.scan import Scan, Store

TEXT_BEARING = ("converted", "skipped_unchanged", "dedup")
STATUSES = ("converted", "failed", "unsupported", "skipped_unchanged", "dedup")


def has_text(status: Column) -> Column:
    return status.isin(*TEXT_BEARING)


def terminal(records: DataFrame) -> DataFrame:
    """The last record of each path within its division, by partial aggregation rather than a sort."""
    rest = [c for c in records.columns if c not in ("division", "source_path")]
    last = records.groupBy("division", "source_path").agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
    return last.select("division", "source_path", "r.*")


def status_counts(records: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return records.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("total"))


def coverage(records: DataFrame) -> DataFrame:
    """Per division, over terminal records: sources, those with text, their share, and the counts by status."""
    counted = status_counts(terminal(records), "division")
    with_text = sum((F.col(s) for s in TEXT_BEARING), F.lit(0))
    share = F.when(F.col("total") == 0, 0.0).otherwise(with_text / F.col("total"))
    return counted.select("division", F.col("total").alias("sources"), with_text.alias("with_text"), share.alias("coverage"), *STATUSES)


def invariant_broken(r: DataFrame) -> Column:
    """The first cross-field rule that a record breaks, or null."""
    text = F.col("text_path").isNotNull() & F.col("text_hash").isNotNull()
    any_text = F.col("text_path").isNotNull() | F.col("text_hash").isNotNull()
    bearing = has_text(F.col("status"))
    return (
        F.when(~F.col("status").isin(*STATUSES), "unknown status")
        .when(bearing & ~text, "text missing")
        .when(bearing & F.col("error").isNotNull(), "error beside text")
        .when(~bearing & any_text, "text without conversion")
        .when((F.col("status") == "dedup") & F.col("dedup_of").isNull(), "dedup_of missing")
        .when((F.col("status") == "failed") & F.col("error").isNull(), "error missing")
    )


def checkpoint(current: DataFrame, prior: DataFrame) -> DataFrame:
    """``current`` with ``skip``: the prior terminal record bears text and has the same key.

    Keys: source_path, source_hash, converter_version, rules_version; a time or size never suffices.
    """
    keys = ("source_hash", "converter_version", "rules_version")
    known = prior.select(F.col("source_path"), F.col("status").alias("prior_status"), *(F.col(k).alias(f"prior_{k}") for k in keys))
    joined = current.join(known, "source_path", "left")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"prior_{k}"))
    skip = F.coalesce(has_text(F.col("prior_status")), F.lit(False)) & same
    return joined.withColumn("skip", skip).drop(*(f"prior_{k}" for k in keys))


def roots_above(path: Column) -> Column:
    """Everything that a path stands below as ``<root>.d/...``: its prefixes before each ``.d/``, the longest last."""
    parts = F.split(path, r"\.d/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".d/"))
    return F.when(F.size(parts) > 1, F.filter(prefixes, lambda p: p != "")).otherwise(F.expr("cast(array() as array<string>)"))


def descendants(records: DataFrame, roots: DataFrame) -> DataFrame:
    """Records below the given roots, with their root, one row for each; an equi-join on derived prefixes, not a prefix join.

    A folder whose name ends in ``.d`` is no root unless a source of that name is one of ``roots``.
    """
    below = records.withColumn("root", F.explode(roots_above(F.col("source_path"))))
    return below.join(roots.select(F.col("source_path").alias("root")).distinct(), "root", "left_semi")


def whole(marked: DataFrame) -> DataFrame:
    """(source_path, intact) of each path and of all that other paths stand below: whether everything there is intact.

    marked: source_path, intact of records with text; partial minima meet a folder with many of them.
    """
    every = marked.select(F.explode(F.concat(F.array("source_path"), roots_above(F.col("source_path")))).alias("source_path"), "intact")
    return every.groupBy("source_path").agg(F.min("intact").alias("intact"))


def removed_members(prior: DataFrame, expanded: DataFrame, emitted: DataFrame) -> DataFrame:
    """A failed record for each member that an earlier run knew below an expanded root, at any depth, and this run did not emit.

    prior: terminal records; expanded: source_path of the top-level containers of this run; emitted: what it recorded. A
    member that is retired already stays so.
    """
    known = prior.where("parent_source is not null").where(~F.coalesce(F.col("error") == "container-member-removed", F.lit(False)))
    gone = descendants(known, expanded).drop("root").dropDuplicates(["source_path"]).join(emitted.select("source_path"), "source_path", "left_anti")
    return gone.select("division", "source_path", "parent_source", "declared_format", F.lit("failed").alias("status"), F.lit("container-member-removed").alias("error"))


def ancestor_prefixes(path: Column) -> Column:
    """Every directory above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def occupied(containers: DataFrame, walked: DataFrame) -> DataFrame:
    """Containers whose member namespace ``<path>.d/`` a real source already stands in."""
    taken = walked.select(F.explode(ancestor_prefixes(F.col("source_path"))).alias("dir")).where(F.endswith("dir", F.lit(".d"))).distinct()
    return containers.join(taken.select(F.expr("substring(dir, 1, length(dir) - 2)").alias("source_path")), "source_path", "left_semi")


def history(records: DataFrame, path: str) -> DataFrame:
    """All records of one source, oldest first."""
    return records.where(F.col("source_path") == path).orderBy("division", "line_no")


def collisions(records: DataFrame) -> DataFrame:
    """Text paths that fall together when case is folded and Unicode composed."""
    keyed = records.where("text_path is not null").select("text_path").distinct().groupBy(bundle_collision_key(F.col("text_path")).alias("fold"))
    return keyed.agg(F.sort_array(F.collect_list("text_path")).alias("paths")).where(F.size("paths") > 1)


def inventory(sources: DataFrame) -> DataFrame:
    """Files and bytes by detected format, with a total (format null)."""
    return sources.rollup("detected_format").agg(F.count(F.lit(1)).alias("files"), F.sum("source_size").alias("bytes"))


def outliers(sources: DataFrame, least: int = 1 << 20, factor: float = 10.0) -> DataFrame:
    """Sources of ``least`` bytes or more and ``factor`` times the mean of all."""
    mean = sources.agg(F.avg("source_size").alias("mean"))
    big = sources.where(F.col("source_size") >= least).join(F.broadcast(mean), F.col("source_size") >= factor * F.col("mean"))
    return big.drop("mean").orderBy(F.desc("source_size"), "source_path")


def claims(members: DataFrame, store: Store) -> DataFrame:
    """Archive members in order; the first with a collision key keeps its path, later ones get a number instead.

    members: root, ord (unique in its root), path. Adds claimed and, for the n-th refused member of a root, a synthetic path. One root may hold all members.
    """
    keyed = members.withColumn("fold", run_collision_key(F.col("path")))
    first = keyed.groupBy("root", "fold").agg(F.min("ord").alias("_first"))
    # written anew, the key gives the join exchanges of its own, which can be split
    met = keyed.join(first.withColumn("root", F.concat("root", F.lit(""))), ["root", "fold"]).withColumn("claimed", F.col("ord") == F.col("_first")).drop("_first", "fold")
    nth = Scan(met, ["root"], ["ord"], store, "claims").sum("_nth", F.when(F.col("claimed"), 0).otherwise(1).cast("long")).rows
    shown = F.when(F.col("claimed"), F.concat("root", F.lit(".d/"), "path")).otherwise(F.concat("root", F.lit(".d/#collision-"), "_nth"))
    return nth.withColumn("child_path", shown).drop("_nth")


def expansion_budget(members: DataFrame, limit: int, store: Store) -> DataFrame:
    """Running total of inflated bytes in each root, and whether a member still fits. One root may hold all members."""
    total = Scan(members, ["root"], ["ord"], store, "budget").sum("total", F.col("size")).rows
    return total.withColumn("fits", F.col("total") <= limit)
