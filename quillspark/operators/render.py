"""Detection by joins, comparisons of listings, and renderings in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.scan import Scan, Store
from quillspark.plans import formats


def numbered(rows: DataFrame, order: list[Column], name: str, store: Store) -> DataFrame:
    """Adds the place of each row in a total order, from 1, without sorting all rows in one task."""
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    return Scan(rows.withColumns(keys), [], list(keys), store, f"numbered-{name}").sum(name, F.lit(1).cast("long")).rows.select(*rows.columns, name)


def declared(rows: DataFrame, path: str = "path") -> DataFrame:
    """Adds the format that a path declares: by extension, or by the whole name if it has none."""
    rules = formats.extension_rules(rows.sparkSession).select(F.col("extension").alias("_ext"), F.col("format").alias("_format"))
    names = F.create_map(*(F.lit(x) for pair in formats.BASENAMES.items() for x in pair))
    joined = rows.withColumn("_key", T.extension(F.col(path))).join(F.broadcast(rules), F.col("_key") == F.col("_ext"), "left")
    return joined.withColumn("declared", F.when(F.col("_key").isNull(), names[T.basename(F.col(path))]).otherwise(F.col("_format"))).drop("_key", "_ext", "_format")


def resolved(rows: DataFrame, path: str = "path", magic: str = "magic") -> DataFrame:
    """Adds declared, detected, format_mismatch and warning, from the path and the extension that the bytes show."""
    rules = formats.extension_rules(rows.sparkSession).select(F.col("extension").alias("_magic"), F.col("format").alias("_seen"))
    refines = F.create_map(*(F.lit(x) for pair in formats.REFINES.items() for x in pair))
    both = declared(rows, path).join(F.broadcast(rules), F.col(magic) == F.col("_magic"), "left")
    d, seen = F.col("declared"), F.col("_seen")
    refined = F.coalesce(refines[d] == seen, F.lit(False))
    detected = F.when(seen.isNull(), F.coalesce(d, F.lit("unknown"))).when(refined, d).otherwise(seen)
    outside = F.when(F.col(magic).isNotNull() & seen.isNull(), F.concat(F.lit("magic-format-outside-table: "), F.col(magic)))
    mismatch = F.coalesce(seen.isNotNull() & d.isNotNull() & (d != seen) & ~refined, F.lit(False))
    return both.withColumns({"detected": detected, "format_mismatch": mismatch, "warning": outside}).drop("_magic", "_seen")


def routed(rows: DataFrame, detected: str = "detected") -> DataFrame:
    """Adds converter_id, converter_version and the reason where there is no converter."""
    rules = formats.route_rules(rows.sparkSession).withColumnRenamed("format", "_format")
    joined = rows.join(F.broadcast(rules), F.col(detected) == F.col("_format"), "left").drop("_format")
    return joined.withColumn("reason", F.when(F.col("converter_id").isNull(), F.coalesce("reason", F.lit("no-converter"))))


def compared(listed: DataFrame, tree: DataFrame) -> DataFrame:
    """path and state (ok, missing, unlisted, mismatch) of a checksum list against a tree."""
    joined = listed.withColumnRenamed("hash", "_listed").join(tree.withColumnRenamed("hash", "_found"), "path", "full_outer")
    state = F.when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.col("_found") != F.col("_listed"), "mismatch").otherwise("ok")
    return joined.select("path", state.alias("state"))


def counts_compared(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """division, field, recorded, found and differs, for every count of either side."""
    fields = [c for c in recorded.columns if c not in ("division", "total")]
    tall = lambda df, name: df.select("division", F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', {f}" for f in fields) + f") as (field, {name})"))
    joined = tall(recorded, "recorded").join(tall(found, "found"), ["division", "field"], "full_outer")
    return joined.withColumn("differs", F.coalesce(F.col("recorded") != F.col("found"), F.lit(True)))


def order_breaks(rows: DataFrame, place: str, column: str, store: Store) -> DataFrame:
    """Adds ``rising`` to a list as it is given, by its ``place``: whether each value is above the one before; the first is."""
    seen = Scan(rows, [], [place], store, "listed").lag("_before", F.struct(F.col(column).alias("v"))).rows
    return seen.withColumn("rising", F.col("_before").isNull() | F.coalesce(F.col(column) > F.col("_before.v"), F.lit(False))).drop("_before")


def collapsed_states(rows: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """Rows whose text differs from that of the row before, in each group."""
    before = F.lag(text).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(text))).drop("_before")


def transcript(rows: DataFrame, key: str) -> DataFrame:
    """One text per key: ``[HH:MM:SS -> HH:MM:SS] Speaker n: text`` lines by start, end and speaker; rows: start, end, speaker, text."""
    line = F.concat(F.lit("["), T.timecode(F.col("start")), F.lit(" -> "), T.timecode(F.col("end")), F.lit("] Speaker "), F.col("speaker"), F.lit(": "), T.single_line(F.col("text")), F.lit("\n"))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", line.alias("line")))).alias("lines"))
    return gathered.select(key, F.array_join(F.transform("lines", lambda s: s["line"]), "").alias("transcript"))


def spans(rows: DataFrame, group: list[str], order: list[str], text: str, store: Store) -> DataFrame:
    """UTF-8 byte spans [start, end) of texts that stand one to a line, in groups of any size."""
    size = F.octet_length(text).cast("long")
    done = Scan(rows, group, order, store, "spans").sum("end", size + 1).rows
    return done.withColumn("start", F.col("end") - size - 1).withColumn("end", F.col("end") - 1)


def tsv_rows(rows: DataFrame, key: str) -> DataFrame:
    """Each row as one line of escaped cells between tabs; null is empty."""
    cells = [T.escape_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
    return rows.select(key, F.concat_ws("\t", *cells).alias("line"))


def looked_up(cells: DataFrame, known: DataFrame, at: list[str]) -> DataFrame:
    """Cells with what is known of their place, one row for each cell; known: at most one row for a place."""
    return cells.join(known, at, "left")
