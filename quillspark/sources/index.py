"""An index of the manifest: its records as Parquet, by division, clustered by path, with Bloom filters on path and hash.

The shards stay what counts; the index is derived from them and may be deleted. It grows by generations: a refresh reads the
bytes that a shard has gained, and merges with them the generations that are no larger, so that a record is written anew
about once for each doubling of its shard and few generations stand at any time. A look-up by path or hash opens one
division's files at most, and of these the row groups that may hold it.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import shard
from quillspark.sources.mirror import write_whole

FOLDER, NOTE = ".index", "NOTE"
#: A record of the index: ``span`` tells the refresh that read it, and orders records before ``line_no`` does.
FRAME = f"{shard.COLUMNS}, line_no long, span long, division string, generation long"
#: Bytes before the indexed end that must be what they were.
TAIL = 4096
#: Rows of a row group are chosen by bytes: small ones, for look-ups.
ROW_GROUP = 8 << 20


def written(records: DataFrame, folder: str) -> None:
    """A generation: records in order of their paths, in files that hold a range of paths each."""
    ordered = records.repartitionByRange("source_path", "span", "line_no").sortWithinPartitions("source_path", "span", "line_no")
    writer = ordered.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP))
    for column in ("source_path", "source_hash"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    # of filters of 1 MB, 512 KB and so on down to 2 KB, a row group keeps the smallest that holds its values
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number", "10")
    writer.parquet(folder)


def _last_line_end(path: str) -> int:
    return os.path.getsize(path) - len(shard.unended(path))


def _before(path: str, end: int) -> str:
    with open(path, "rb") as file:
        file.seek(max(0, end - TAIL))
        return file.read(min(TAIL, end)).hex()


class Index:
    """The index of a manifest folder's shards; one process at a time refreshes it."""

    def __init__(self, spark: SparkSession, manifest_dir: str):
        self.spark, self.manifest_dir = spark, os.path.abspath(manifest_dir)
        self.folder = os.path.join(self.manifest_dir, FOLDER)

    def _place(self, division: str, generation: int | None = None) -> str:
        place = os.path.join(self.folder, f"division={division}")
        return place if generation is None else os.path.join(place, f"generation={generation}")

    def _note(self, division: str) -> dict:
        """What stands: the indexed end of the shard, the bytes before it, and [generation, bytes of shard] in order."""
        try:
            with open(os.path.join(self._place(division), NOTE), "rb") as file:
                return json.load(file)
        except FileNotFoundError:
            return {"end": 0, "before": "", "next": 0, "generations": []}

    def refresh(self, division: str) -> list[int]:
        """Index what a shard has gained; all of it if it is not what it was. Gives the generations that stand.

        A last line without its end waits until it has one.
        """
        path = os.path.join(self.manifest_dir, f"{division}.jsonl")
        note, end = self._note(division), _last_line_end(path)
        if end < note["end"] or _before(path, note["end"]) != note["before"]:
            shutil.rmtree(self._place(division), ignore_errors=True)
            note = self._note(division)
        if end == note["end"]:
            return [g for g, _ in note["generations"]]
        size, stay, merged = end - note["end"], list(note["generations"]), []
        while stay and stay[-1][1] <= size:
            merged.append(stay.pop())
            size += merged[-1][1]
        number = note["next"]
        gained = os.path.join(self._place(division), "gained")
        os.makedirs(gained, exist_ok=True)
        lines = os.path.join(gained, "lines")
        with open(path, "rb") as source, open(lines, "wb") as out:
            source.seek(note["end"])
            left = end - note["end"]
            while left:
                left -= out.write(source.read(min(left, 1 << 24)))
        records = shard.read(self.spark, lines, division, strict=True)[0].drop("division").withColumn("span", F.lit(number).cast("long"))
        if merged:
            records = records.unionByName(self._read([self._place(division, g) for g, _ in merged]).drop("division", "generation"))
        written(records, self._place(division, number))
        note |= {"end": end, "before": _before(path, end), "next": number + 1, "generations": [*stay, [number, size]]}
        write_whole(os.path.join(self._place(division), NOTE), json.dumps(note).encode())
        for g, _ in merged:  # not named any more
            shutil.rmtree(self._place(division, g), ignore_errors=True)
        shutil.rmtree(gained)
        return [g for g, _ in note["generations"]]

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], FRAME)
        return self.spark.read.schema(FRAME).option("basePath", self.folder).parquet(*places)

    def records(self) -> DataFrame:
        """All divisions' records (``FRAME``), after a refresh; filters on division, source_path and source_hash prune."""
        divisions = sorted(n.removesuffix(".jsonl") for n in os.listdir(self.manifest_dir) if n.endswith(".jsonl"))
        return self._read([self._place(d, g) for d in divisions for g in self.refresh(d)])

    def history(self, where: Column) -> DataFrame:
        """The records that a condition on division, source_path or source_hash names, oldest first."""
        return self.records().where(where).orderBy("division", "span", "line_no")
