"""Record files to tab-separated text: parquet, avro and sqlite from their bytes."""

from __future__ import annotations

import datetime
import decimal
import io
import json
import os
import sqlite3
import struct
import tempfile
import unicodedata
import zlib
from collections.abc import Callable, Iterator

from quillspark.converters.base import ConvertError, Outcome, Segment
from quillspark.plans import formats


def escape_cell(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def number(value: float) -> str:
    """A double without exponent or needless fraction."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    text = format(decimal.Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


class Sink:
    """Lines that stay under the ceilings for bytes and records."""

    def __init__(self, max_bytes: int = formats.MAX_OUTPUT, max_records: int = formats.MAX_RECORDS):
        self.lines: list[str] = []
        self.size, self.max_bytes, self.max_records = 0, max_bytes, max_records

    def row(self, cells: list[str]) -> None:
        line = "\t".join(map(escape_cell, cells)) + "\n"
        self.text(line)

    def text(self, line: str) -> None:
        self.size += len(line.encode())
        if self.size > self.max_bytes:
            raise ConvertError("record-limit-exceeded", f"output exceeds {self.max_bytes} bytes")
        self.lines.append(line)

    def records(self, rows: Iterator[list[str]]) -> None:
        for k, cells in enumerate(rows):
            if k >= self.max_records:
                raise ConvertError("record-limit-exceeded", f"more than {self.max_records} records")
            self.row(cells)


def _parquet_cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return number(value)
    if isinstance(value, bytes):
        return "[" + ", ".join(map(str, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_nested(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        if value and all(isinstance(v, tuple) for v in value):
            return "{" + ", ".join(f"{_nested(k)} -> {_nested(v)}" for k, v in value) + "}"
        return "[" + ", ".join(map(_nested, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3] + " +00:00"
    return str(value)


def _nested(value: object) -> str:
    if value is None:
        return "null"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else _parquet_cell(value)


def parquet(data: bytes, sink: Sink) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        file = pq.ParquetFile(io.BytesIO(data))
        sink.row(file.schema_arrow.names)
        sink.records(list(map(_parquet_cell, row)) for b in file.iter_batches(4096) for row in zip(*(c.to_pylist() for c in b.columns)))
    except (pa.ArrowException, OSError) as e:
        raise ConvertError("malformed", f"not a readable parquet file: {e}") from None


class _Avro:
    """Values of an avro object container file, rendered as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.named = data, 0, {}

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ConvertError("malformed", "avro data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if not byte & 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise ConvertError("malformed", "avro number is too long")

    def blocks(self) -> Iterator[None]:
        while (n := self.long()) != 0:
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                yield

    def learn(self, schema: object) -> None:
        """Remember named types, so that they can be referred to."""
        if isinstance(schema, list):
            for s in schema:
                self.learn(s)
        elif isinstance(schema, dict):
            if schema.get("name") and schema["type"] in ("record", "error", "enum", "fixed"):
                space = schema.get("namespace")
                self.named[schema["name"]] = schema
                self.named[f"{space}.{schema['name']}" if space else schema["name"]] = schema
            for part in (schema.get("items"), schema.get("values"), *(f["type"] for f in schema.get("fields", ()))):
                self.learn(part)
            if isinstance(schema.get("type"), (dict, list)):
                self.learn(schema["type"])

    def cell(self, schema: object, depth: int = 0) -> str:
        if depth > 64:
            raise ConvertError("malformed", "avro nesting is too deep")
        if isinstance(schema, list):
            branch = self.long()
            if not 0 <= branch < len(schema):
                raise ConvertError("malformed", "no such avro union branch")
            return self.cell(schema[branch], depth + 1)
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, (dict, list)):
            return self.cell(kind, depth + 1)
        simple: dict[str, Callable[[], str]] = {
            "null": lambda: "",
            "boolean": lambda: "true" if self.take(1)[0] else "false",
            "int": lambda: str(self.long()),
            "long": lambda: str(self.long()),
            "float": lambda: self._single(),
            "double": lambda: number(struct.unpack("<d", self.take(8))[0]),
            "string": lambda: self._string(),
            "bytes": lambda: self.take(self.long()).hex(),
        }
        if kind in simple:
            return simple[kind]()
        if kind == "fixed":
            return self.take(schema["size"]).hex()
        if kind == "enum":
            k = self.long()
            if not 0 <= k < len(schema["symbols"]):
                raise ConvertError("malformed", "no such avro symbol")
            return schema["symbols"][k]
        if kind == "array":
            return "[" + ", ".join([self.cell(schema["items"], depth + 1) for _ in self.blocks()]) + "]"
        if kind == "map":
            return "{" + ", ".join(sorted([f"{self._string()}: {self.cell(schema['values'], depth + 1)}" for _ in self.blocks()])) + "}"
        if kind in ("record", "error"):
            return "{" + ", ".join([f"{f['name']}: {self.cell(f['type'], depth + 1)}" for f in schema["fields"]]) + "}"
        if kind in self.named:
            return self.cell(self.named[kind], depth + 1)
        raise ConvertError("malformed", f"unknown avro type {kind}")

    def _string(self) -> str:
        try:
            return self.take(self.long()).decode()
        except UnicodeDecodeError:
            raise ConvertError("malformed", "avro string isn't UTF-8") from None

    def _single(self) -> str:
        import numpy as np

        return number(float(str(np.float32(struct.unpack("<f", self.take(4))[0]))))

    def container(self, sink: Sink) -> None:
        if self.take(4) != b"Obj\x01":
            raise ConvertError("malformed", "not a readable avro file: no magic")
        meta = {self._string(): self.take(self.long()) for _ in self.blocks()}
        mark = self.take(16)
        try:
            schema = json.loads(meta["avro.schema"])
        except (KeyError, ValueError):
            raise ConvertError("malformed", "not a readable avro file: no schema") from None
        codec = meta.get("avro.codec", b"null").decode()
        self.learn(schema)
        record = isinstance(schema, dict) and schema["type"] == "record"
        sink.row([f["name"] for f in schema["fields"]] if record else ["value"])

        def rows() -> Iterator[list[str]]:
            while self.at < len(self.data):
                count, size = self.long(), self.long()
                body = self.take(size)
                if codec == "deflate":
                    inflater = zlib.decompressobj(-15)
                    body = inflater.decompress(body, sink.max_bytes)
                    if inflater.unconsumed_tail:
                        raise ConvertError("record-limit-exceeded", "an avro block inflates over the ceiling")
                elif codec != "null":
                    raise ConvertError("malformed", f"avro codec {codec}")
                inner = _Avro(body)
                inner.named = self.named
                for _ in range(count):
                    yield [inner.cell(f["type"]) for f in schema["fields"]] if record else [inner.cell(schema)]
                if self.take(16) != mark:
                    raise ConvertError("malformed", "avro sync mark differs")

        sink.records(rows())


def avro(data: bytes, sink: Sink) -> None:
    try:
        _Avro(data).container(sink)
    except (struct.error, zlib.error, KeyError, TypeError, UnicodeDecodeError) as e:
        raise ConvertError("malformed", f"cannot decode a record: {e}") from None


def sqlite(data: bytes, sink: Sink) -> tuple[list[Segment], list[str]]:
    if data[:16] != b"SQLite format 3\0":
        raise ConvertError("not_sqlite", "no sqlite header")
    segments, warnings = [], []
    handle, path = tempfile.mkstemp(suffix=".sqlite")  # the reader wants a file; it lives as long as this call
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        base = sqlite3.connect(f"file:{path}?immutable=1&mode=ro", uri=True)
        try:
            base.text_factory = bytes
            base.setlimit(sqlite3.SQLITE_LIMIT_ATTACHED, 0)
            base.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, min(sink.max_bytes, 2**31 - 1))
            base.execute("PRAGMA trusted_schema=OFF")
            names = sorted(n.decode("utf-8", "replace") for (n,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\'"))
            if len(names) > formats.MAX_TABLES:
                raise ConvertError("record-limit-exceeded", f"more than {formats.MAX_TABLES} tables")
            for name in names:
                if sink.size:
                    sink.text("\n")
                start, lossy = sink.size, False
                quoted = '"' + name.replace('"', '""') + '"'
                try:
                    rows = base.execute(f"SELECT * FROM {quoted} ORDER BY _rowid_")
                except sqlite3.OperationalError:
                    rows = base.execute(f"SELECT * FROM {quoted}")
                sink.row([d[0] if isinstance(d[0], str) else d[0].decode() for d in rows.description])
                columns = [c[1].decode("utf-8", "replace") if isinstance(c[1], bytes) else c[1] for c in base.execute(f"PRAGMA table_info({quoted})")]
                kinds = base.execute("SELECT " + ", ".join('typeof("' + c.replace('"', '""') + '")' for c in columns) + f" FROM {quoted}" + " ORDER BY _rowid_" * ("ORDER" in _order(base, quoted)))

                def cells() -> Iterator[list[str]]:
                    nonlocal lossy
                    for row, types in zip(rows, kinds):
                        out = []
                        for v, t in zip(row, types):
                            if v is None:
                                out.append("")
                            elif isinstance(v, bytes) and t == b"blob":
                                out.append(v.hex())
                            elif isinstance(v, bytes):
                                try:
                                    out.append(v.decode())
                                except UnicodeDecodeError:
                                    lossy = True
                                    out.append(v.decode("utf-8", "replace"))
                            else:
                                out.append(number(v) if isinstance(v, float) else str(v))
                        yield out

                sink.records(cells())
                if lossy:
                    warnings.append(f"invalid-utf8-replaced: {name}")
                segments += [Segment("sheet", start, start, "sheet", name), Segment("span", start, sink.size, "sheet", name)]
        finally:
            base.close()
    except sqlite3.Error as e:
        raise ConvertError("records_read_error", str(e)) from None
    finally:
        os.unlink(path)
    return segments, warnings


def _order(base: sqlite3.Connection, quoted: str) -> str:
    try:
        base.execute(f"SELECT 1 FROM {quoted} ORDER BY _rowid_ LIMIT 0")
        return "ORDER BY _rowid_"
    except sqlite3.OperationalError:
        return ""


def convert(data: bytes, fmt: str, max_records: int = formats.MAX_RECORDS) -> Outcome:
    sink = Sink(max_records=max_records)
    segments, warnings = [], []
    if fmt == "parquet":
        parquet(data, sink)
    elif fmt == "avro":
        avro(data, sink)
    elif fmt == "sqlite":
        segments, warnings = sqlite(data, sink)
    else:
        raise ConvertError("unclaimed_format", fmt)
    text = "".join(sink.lines)
    if not segments:
        segments = [Segment("span", 0, sink.size, "document")]
    return Outcome(text, "records-worker", warnings, sorted(segments, key=lambda s: (s.start, s.end)))
