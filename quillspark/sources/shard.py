"""Manifest shards: JSON lines with a fixed field order, written once and read strictly."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record format this engine writes and reads; a caller may accept others of the same fields.
SCHEMA = "quillspark/manifest@1"
FIELDS = (
    "schema source_path source_hash source_size declared_format detected_format format_mismatch status text_path text_hash artifact_kind converter_id "
    "converter_version tool_version rules_version media parent_source dedup_of warnings error duration_ms"
).split()
MEDIA = "duration_seconds double, language string, model_id string, model_hash string, decode_options_hash string, speaker_count int"
MEDIA_FIELDS = [f.split()[0] for f in MEDIA.split(", ")]
REQUIRED = ("schema", "source_path", "source_hash", "source_size", "detected_format", "format_mismatch", "status", "rules_version")
#: The columns of a record, and the frame of a shard's records, whose order is (division, line_no).
RECORD = {
    "source_path": "string", "source_hash": "string", "source_size": "long", "declared_format": "string", "detected_format": "string", "format_mismatch": "boolean",
    "status": "string", "text_path": "string", "text_hash": "string", "artifact_kind": "string", "converter_id": "string", "converter_version": "string",
    "tool_version": "string", "rules_version": "string", "media": f"struct<{MEDIA.replace(' ', ':').replace(',:', ',')}>", "parent_source": "string", "dedup_of": "string",
    "warnings": "array<string>", "error": "string", "duration_ms": "long",
}
RECORD_FIELDS = list(RECORD)
COLUMNS = ", ".join(f"{n} {t}" for n, t in RECORD.items())
FRAME = f"division string, line_no long, {COLUMNS}"


_KINDS: dict[str, type | tuple] = {"string": str, "long": int, "boolean": bool, "struct": dict, "array": list}


class ShardError(ValueError):
    """A shard's bytes are not what was written."""


def problem(record: dict, accepted: tuple[str, ...] = (SCHEMA,)) -> str | None:
    """The first rule a record breaks."""
    extra = record.keys() - set(FIELDS)
    if extra:
        return f"unknown field {sorted(extra)[0]}"
    missing = [f for f in REQUIRED if record.get(f) is None]
    if missing:
        return f"missing field {missing[0]}"
    if record["schema"] not in accepted:
        return f"schema {record['schema']!r}"
    wrong = [f for f, t in RECORD.items() if record.get(f) is not None and not isinstance(record[f], _KINDS[t.split("<")[0]])]
    if wrong:
        return f"{wrong[0]} is of another type"
    if record.get("media") is not None and record["media"].keys() - set(MEDIA_FIELDS):
        return f"unknown field media.{sorted(record['media'].keys() - set(MEDIA_FIELDS))[0]}"
    bearing = record["status"] in ("converted", "skipped_unchanged", "dedup")
    texts = [record.get(f) for f in ("text_path", "text_hash")]
    if record["status"] not in ("converted", "failed", "unsupported", "skipped_unchanged", "dedup"):
        return f"status {record['status']!r}"
    if bearing and (None in texts or record.get("error") is not None):
        return "a text-bearing record needs its text and no error"
    if not bearing and texts != [None, None]:
        return "a record without text names one"
    if record["status"] == "dedup" and not record.get("dedup_of"):
        return "dedup without dedup_of"
    return "failed without error" if record["status"] == "failed" and not record.get("error") else None


def encode(record: dict) -> str:
    """One line; null fields and empty warnings are left out."""
    shown = {"schema": SCHEMA} | {f: record[f] for f in FIELDS if record.get(f) is not None and not (f == "warnings" and not record[f])}
    if "media" in shown:
        shown["media"] = {f: shown["media"][f] for f in MEDIA_FIELDS if shown["media"].get(f) is not None}
    wrong = problem(shown)
    if wrong:
        raise ShardError(wrong)
    return json.dumps({f: shown[f] for f in FIELDS if f in shown}, ensure_ascii=False, separators=(",", ":")) + "\n"


def parsed(line: bytes, accepted: tuple[str, ...] = (SCHEMA,)) -> tuple[dict | None, str | None]:
    """A line's record, or what is wrong with it."""
    if line.endswith(b"\r"):
        return None, "carriage return before the line's end"
    try:
        record = json.loads(line.decode("utf-8"))
    except ValueError as e:
        return None, str(e)
    wrong = problem(record, accepted) if isinstance(record, dict) else "not an object"
    return (None, wrong) if wrong else (record, None)


def decode(data: bytes, strict: bool = False, accepted: tuple[str, ...] = (SCHEMA,)) -> tuple[list[dict], list[str]]:
    """Records and warnings of a shard's bytes.

    A last line without its end stays if it is whole, else it is dropped with a warning; ``strict`` refuses it. Any
    other damage fails the read and names the line.
    """
    lines = data.split(b"\n")
    tail = lines.pop()
    records, warnings = [], []
    if tail and strict:
        raise ShardError("the last line has no end")
    for k, line in enumerate(lines, 1):
        record, wrong = parsed(line, accepted)
        if wrong:
            raise ShardError(f"line {k}: {wrong}")
        records.append(record)
    if tail:
        record, wrong = parsed(tail, accepted)
        if wrong:
            warnings.append(f"discarded torn final line {len(lines) + 1}")
        else:
            records.append(record)
    return records, warnings


def unended(path: str, step: int = 1 << 16) -> bytes:
    """The bytes after a file's last line end, found from behind."""
    with open(path, "rb") as file:
        at, tail = file.seek(0, os.SEEK_END), b""
        while at and b"\n" not in tail:
            size = min(step, at)
            at -= size
            file.seek(at)
            tail = file.read(size) + tail
    return tail.rpartition(b"\n")[2]


def repair(path: str) -> None:
    """End the last line of a shard before it grows if it is whole, else cut it off."""
    if os.path.exists(path):
        tail = unended(path)
        if tail:
            with open(path, "rb+") as file:
                if parsed(tail)[1] is None:
                    file.seek(0, os.SEEK_END)
                    file.write(b"\n")
                else:
                    file.truncate(os.path.getsize(path) - len(tail))


def joined(folder: str, path: str, tail: bytes = b"") -> None:
    """Files of lines that executors wrote, in the order of their names, as one shard; bytes are copied, not parsed."""
    with open(path, "wb") as out:
        for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
            with open(os.path.join(folder, name), "rb") as part:
                shutil.copyfileobj(part, out)
        out.write(tail)


def read(spark: SparkSession, path: str, division: str, strict: bool = False, accepted: tuple[str, ...] = (SCHEMA,)) -> tuple[DataFrame, list[str]]:
    """The frame of a shard and warnings, as :func:`decode` has them; lines are parsed by executors.

    The shard stands on storage that driver and executors share.
    """
    tail = unended(path)
    if tail and strict:
        raise ShardError(f"{division}: the last line has no end")
    torn = bool(tail) and parsed(tail, accepted)[1] is not None
    lines = spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("value"))
    if torn:
        lines = lines.where(F.col("line_no") < lines.agg(F.max("line_no")).first()[0])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line_no, value in batch.itertuples(index=False, name=None):
                record, wrong = parsed(bytes(value), accepted)
                shown = {} if wrong else record
                media = shown.get("media")
                rows.append([division, line_no, *({f: media.get(f) for f in MEDIA_FIELDS} if n == "media" and media else shown.get(n) for n in RECORD_FIELDS), wrong])
            yield pd.DataFrame(rows, columns=["division", "line_no", *RECORD_FIELDS, "wrong"], dtype=object)

    frame = lines.mapInPandas(parse, f"{FRAME}, wrong string")
    first = frame.where("wrong is not null").select("line_no", "wrong").orderBy("line_no").limit(1).collect()
    if first:
        raise ShardError(f"{division}: line {lines.where(F.col('line_no') < first[0].line_no).count() + 1}: {first[0].wrong}")
    warnings = [f"{division}: discarded torn final line {lines.count() + 1}"] if torn else []
    return frame.drop("wrong"), warnings
