"""Runs as files arrive: over the whole tree whenever something is new, or over what is new alone."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.run import run
from quillspark.sources import walk


def _started(rows: DataFrame, batch: object, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch(spark: SparkSession, root: str, mirror: str, manifest_dir: str, division: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that runs the division again, as a whole, whenever new files stand under ``root``.

    The manifest, not the stream, says what is done, so a batch that is tried again after a failure skips what is intact.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            run(rows.sparkSession, root, mirror, manifest_dir, division)

    return _started(arrivals, batch, checkpoint, available_now)


def follow(
    spark: SparkSession, root: str, mirror: str, manifest_dir: str, division: str, checkpoint: str, available_now: bool = True, settle: float = 2.0, engines: dict[str, str] | None = None
) -> StreamingQuery:
    """Start a query that walks, hashes and converts what arrives at the top of ``root`` and nothing else.

    Files and folders arrive by being moved there when they are complete (see ``sources.walk``). Each batch is one run over its
    arrivals: contents that older sources hold are borrowed from their artifacts. A batch's lines are published with its number,
    so one that is tried again after it was published adds nothing. What is taken away stays in the manifest: :func:`run` over
    the whole tree looks at everything.
    """
    walk.register(spark)
    arrivals = spark.readStream.format("tree").option("root", root).option("settle", str(settle)).load()

    def batch(rows: DataFrame, number: int) -> None:
        run(rows.sparkSession, root, mirror, manifest_dir, division, engines, rows, f"{os.path.abspath(checkpoint)} {number}")

    return _started(arrivals, batch, checkpoint, available_now)
