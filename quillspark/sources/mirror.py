"""The mirror as a sink with a commit protocol.

Tasks stage whole artifacts in folders of their own and nothing else; the commit names the tasks that count, and only then
is anything published, by renames that may be repeated. What a killed task or a failed run has staged is named by no commit
and dropped. A run that ended between commit and publication is carried forward by the next.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.sources import shard

#: Rows of the sink: where an artifact belongs below the mirror, and its two files; null text: what stands there goes.
SCHEMA = "target string, text binary, sidecar binary"
#: Rows of a publication: a staged artifact's stem, or null, and where it belongs.
MOVES = "staged string, target string"
ENDINGS = (".txt", ".segments.jsonl")
COMMITTED, APPENDING, TOKEN, LINES, TASKS = "COMMITTED", "APPENDING", "TOKEN", "lines", "tasks"


def write_whole(path: str, data: bytes) -> None:
    """A file whole or not at all, in an existing folder."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as file:
        file.write(data)
    os.replace(temporary, path)


@dataclass
class Staged(WriterCommitMessage):
    task: str
    artifacts: int


class _Stager(DataSourceArrowWriter):
    """Stages artifacts; commits by one small file that names the tasks."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task = uuid.uuid4().hex
        place = os.path.join(self.folder, TASKS, task)
        os.makedirs(place)
        count = 0
        with open(os.path.join(place, "index.jsonl"), "w", encoding="utf-8") as index:
            for batch in iterator:
                for target, text, side in zip(*(batch.column(c) for c in ("target", "text", "sidecar"))):
                    stem = None
                    if text.is_valid:
                        stem = os.path.join(place, str(count))
                        for end, value in zip(ENDINGS, (text, side)):
                            with open(stem + end, "wb") as file:
                                file.write(value.as_buffer())
                        count += 1
                    index.write(json.dumps({"staged": stem, "target": target.as_py()}) + "\n")
        return Staged(task, count)

    def commit(self, messages: list[Staged | None]) -> None:
        tasks = [m.task for m in messages if m is not None]
        write_whole(os.path.join(self.folder, COMMITTED), json.dumps({"tasks": tasks}).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(os.path.join(self.folder, TASKS), ignore_errors=True)


class _Publisher(DataSourceArrowWriter):
    """Moves staged artifacts to their places; a task that is run again finds its work done and goes on."""

    def __init__(self, mirror: str):
        self.mirror = mirror

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        made = None
        for batch in iterator:
            for staged, target in zip(batch.column("staged").to_pylist(), batch.column("target").to_pylist()):
                place = os.path.join(self.mirror, target)
                if staged is not None and os.path.dirname(place) != made:
                    made = os.path.dirname(place)
                    os.makedirs(made, exist_ok=True)
                for end in ENDINGS:
                    try:
                        if staged is None:
                            os.unlink(place + end)
                        else:
                            os.replace(staged + end, place + end)
                    except (FileNotFoundError, NotADirectoryError):
                        pass  # moved or removed by an attempt before
                    except OSError:
                        if staged is not None:
                            raise
        return WriterCommitMessage()


class Mirror(DataSource):
    """``stage`` writes rows of ``SCHEMA`` into a transaction's folder, ``publish`` rows of ``MOVES`` into the mirror."""

    @classmethod
    def name(cls) -> str:
        return "mirror"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Stager(self.options["stage"]) if "stage" in self.options else _Publisher(self.options["publish"])


def read_back(records: DataFrame, mirror: str) -> DataFrame:
    """The records that have their whole artifact in the mirror, with its text's size and its sidecar's hash.

    records: text_path, text_hash and more columns. Tasks open the files the records name; nothing is listed, and a file is
    read once. A record whose files are missing, or whose text is another, is left out.
    """
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in records.schema.fields)}, text_bytes long, sidecar_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, sides = [], [], []
            for path, wanted in zip(batch.column("text_path").to_pylist(), batch.column("text_hash").to_pylist()):
                right = False
                if path is not None:
                    stem, found = os.path.join(mirror, path.removesuffix(ENDINGS[0])), []
                    try:
                        for end in ENDINGS:
                            with open(stem + end, "rb") as file:
                                found.append((hashlib.file_digest(file, "sha256").hexdigest(), file.tell()))
                    except (FileNotFoundError, NotADirectoryError):
                        pass
                    right = len(found) == 2 and found[0][0] == wanted
                keep.append(right)
                if right:
                    sizes.append(found[0][1])
                    sides.append(found[1][0])
            columns = batch.filter(pa.array(keep, pa.bool_())).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(sides, pa.string())], [*batch.schema.names, "text_bytes", "sidecar_hash"])

    return records.mapInArrow(run, out)


class Transaction:
    """One run's changes to a division: artifacts and manifest lines, staged together and published together."""

    def __init__(self, spark: SparkSession, mirror: str, shard_path: str, division: str):
        self.spark, self.mirror, self.shard_path = spark, os.path.abspath(mirror), shard_path
        self.folder = os.path.join(self.mirror, f".staged-{division}")  # a division's name has no dot
        self.token_path = f"{shard_path}.token"
        spark.dataSource.register(Mirror)

    def recover(self) -> bool:
        """Carry a committed transaction of an earlier run forward, or drop what was not committed; whether there was one to carry."""
        committed = os.path.exists(os.path.join(self.folder, COMMITTED))
        if committed:
            self.publish()
        shutil.rmtree(self.folder, ignore_errors=True)
        return committed

    def published(self) -> str | None:
        """The token of the last transaction with one whose changes are all in place."""
        try:
            with open(self.token_path, "rb") as file:
                return file.read().decode()
        except FileNotFoundError:
            return None

    def stage(self, artifacts: DataFrame, lines: DataFrame, token: str | None = None) -> None:
        """Stage lines (value, in order by partition) and artifacts (``SCHEMA``), then commit; the token is published with them."""
        os.makedirs(self.folder)
        if token is not None:
            write_whole(os.path.join(self.folder, TOKEN), token.encode())
        lines.write.text(os.path.join(self.folder, LINES), lineSep="\n")
        artifacts.write.format("mirror").option("stage", self.folder).mode("append").save()

    def publish(self) -> None:
        """Move what was committed to its places, and append the lines; may be repeated from wherever it ended."""
        with open(os.path.join(self.folder, COMMITTED), "rb") as file:
            tasks = json.load(file)["tasks"]
        if tasks:
            staged = [os.path.join(self.folder, TASKS, t, "index.jsonl") for t in tasks]
            moves = self.spark.read.schema(MOVES).json(staged)
            moves.write.format("mirror").option("publish", self.mirror).mode("append").save()
        self._append()
        token = os.path.join(self.folder, TOKEN)
        if os.path.exists(token):
            with open(token, "rb") as file:
                write_whole(self.token_path, file.read())
        shutil.rmtree(self.folder)

    def _append(self) -> None:
        """The lines at the shard's end; the shard's size before is noted first, so that a second attempt starts from there."""
        note = os.path.join(self.folder, APPENDING)
        if not os.path.exists(note):
            shard.repair(self.shard_path)
            size = os.path.getsize(self.shard_path) if os.path.exists(self.shard_path) else 0
            write_whole(note, json.dumps(size).encode())
        with open(note, "rb") as file:
            size = json.load(file)
        staged = os.path.join(self.folder, LINES)
        with open(self.shard_path, "ab") as out:
            out.truncate(size)
            for name in sorted(n for n in os.listdir(staged) if n.startswith("part-")):
                with open(os.path.join(staged, name), "rb") as part:
                    shutil.copyfileobj(part, out)
