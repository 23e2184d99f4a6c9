"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions only.

Documents come in batches of rising ids. The store keeps, for every line key seen so far, its 128-bit hash and the
smallest document that holds it, as runs that are bucketed and sorted by hash. A batch's keys are merge-anti-joined with
each run, bucket by bucket, and those that are new are written as a run of level 0; when a level has as many runs as
the fan-out, they are merged into one run of the next. A line goes if the runs name a smaller document for its key.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, remove, scratch, unused

#: White space that does not belong to a key (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def hashed(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, row, pos, h1, h2 of each line whose key has at least ``least_chars`` code points.

    ``row`` tells apart rows that share an id; rows without id hold no lines.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", row_mark().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def row_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


class RunStore:
    """Runs of (h1, h2, owner) on shared storage, at most ``fan_out`` - 1 to a level.

    A run is a table in as many buckets as the session has shuffle partitions, by hash, each bucket one sorted file: keys
    that an aggregation has dealt out meet it without another shuffle. The store lives until ``clear``.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 4):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def read(self) -> DataFrame | None:
        """All runs together; each key stands in exactly one of them."""
        return self._union(self.runs())

    def _union(self, names: list[str]) -> DataFrame | None:
        out = None
        for name in names:
            run = self.spark.table(name)
            out = run if out is None else out.unionByName(run)
        return out

    def _write(self, rows: DataFrame) -> str:
        name = f"quillspark_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def add(self, fresh: DataFrame) -> None:
        """Write a run of keys that no run holds yet, dealt out by hash, and compact the levels that are full."""
        made, level = self._write(fresh), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(made)
            if len(self.levels[level]) < self.fan_out:
                return
            old, self.levels[level] = self.levels[level], []
            made = self._write(self._union(old).repartition(self.buckets, *KEY))
            self._drop(old)
            level += 1

    def ingest(self, lines: DataFrame) -> None:
        """Take in the lines (doc_id, h1, h2) of a batch whose ids are above those of all earlier ones."""
        fresh = lines.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        self.add(fresh)

    def clear(self) -> None:
        self._drop(list(self.paths))
        self.levels.clear()


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into about equal batches of rising ids."""
    quantiles = F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)
    return sorted(set(docs.agg(quantiles.alias("q")).first().q or [])) if batches > 1 else []


def dropped_lines(docs: DataFrame, least_chars: int = 10, batches: int = 4, fan_out: int = 3) -> DataFrame:
    """(doc_id, row, lines): the places, from 0, of the lines that each document row loses. The store of runs lives for one call."""
    spark, keep = docs.sparkSession, Scratch(docs.sparkSession)
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for k, bound in enumerate(bounds):
        batch = F.when(F.col("doc_id") > bound, k + 1).otherwise(batch)
    path = keep.path("line-hashes")
    hashed(docs, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    store = RunStore(spark, fan_out)
    for k in range(len(bounds) + 1):
        store.ingest(lines.where(F.col("batch") == k))
    # An owner is the smallest document of its key, so a batch's lines can be judged as soon as its run is in;
    # judging all of them at the end reads the runs once. A very common line's rows are split by AQE.
    gone = lines.join(store.read().hint("merge"), KEY).where(F.col("doc_id") > F.col("owner"))
    out = keep.result(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("lines")), "dropped-lines")
    store.clear()
    return out


def drop_lines(docs: DataFrame, least_chars: int = 10, batches: int = 4, fan_out: int = 3) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped.

    A text is split at newlines; a null or empty text is one empty line. Keys of at least ``least_chars`` code points
    that are found in two documents or more lose all their lines, except in the smallest id that holds them; there all
    stay, however often they occur. Other lines stay as they are, joined by newlines; a text that loses all its lines is
    empty. Rows that share an id are one document; rows without id keep all lines and count for none. An empty table
    gives no rows. The columns of ``docs`` stay, whatever their names, except those three, which are replaced.
    """
    gone = dropped_lines(docs, least_chars, batches, fan_out).toDF("doc", "row", "gone")
    joined = docs.join(gone, (docs["doc_id"] == gone["doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["row"]), "left")
    own = unused("_lines", joined.columns)
    text, lost = F.coalesce(docs["text"], F.lit("")), gone["gone"]
    cut = joined.withColumn(own, F.split(text, "\n"))  # a column, so that no lambda splits the text anew
    places = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), lost)
    kept = F.array_join(F.transform(places, lambda i: F.get(own, i)), "\n")
    made = ("kept_text", "n_lines", "n_dropped")
    return cut.select(
        *(docs[c] for c in docs.columns if c not in made),
        F.when(lost.isNull(), text).otherwise(kept).alias("kept_text"),
        F.size(own).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )
