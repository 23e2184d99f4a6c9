"""Small files of each kind, made from table rows, so that converters can be run and checked over whole tables."""

from __future__ import annotations

import base64
import io
import json
import os
import shutil
import sqlite3
import struct
import tempfile
import wave
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def zip_of(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return out.getvalue()


def mail_of(sender: str, subject: str, body: str, attachment: tuple[str, bytes]) -> bytes:
    wrapped = lambda data: base64.encodebytes(data).decode()
    return (
        f'From: {sender}\nSubject: {subject}\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=b="\n\n'
        f"--=b=\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{wrapped(body.encode())}\n"
        f'--=b=\nContent-Type: text/plain; charset=utf-8\nContent-Disposition: attachment; filename="{attachment[0]}"\nContent-Transfer-Encoding: base64\n\n{wrapped(attachment[1])}\n--=b=--\n'
    ).encode()


def sqlite_of(table: str, columns: str, rows: list[tuple]) -> bytes:
    handle, path = tempfile.mkstemp(suffix=".sqlite")
    os.close(handle)
    try:
        base = sqlite3.connect(path)
        base.execute(f"CREATE TABLE {table} ({columns})")
        base.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns.split(',')))})", rows)
        base.commit()
        base.close()
        with open(path, "rb") as file:
            return file.read()
    finally:
        os.unlink(path)


def parquet_of(columns: dict[str, list]) -> bytes:
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.table(columns), out)
    return out.getvalue()


def _zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def avro_of(fields: list[tuple[str, str]], rows: list[tuple]) -> bytes:
    """An object container of records of longs and strings."""
    text = lambda s: _zigzag(len(s)) + s
    schema = json.dumps({"type": "record", "name": "row", "fields": [{"name": n, "type": t} for n, t in fields]}).encode()
    head = b"Obj\x01" + _zigzag(2) + text(b"avro.schema") + text(schema) + text(b"avro.codec") + text(b"deflate") + _zigzag(0)
    body = b"".join(_zigzag(v) if t == "long" else text(v.encode()) for row in rows for v, (_, t) in zip(row, fields))
    deflate = zlib.compressobj(wbits=-15)
    packed = deflate.compress(body) + deflate.flush()
    mark = b"0123456789abcdef"
    return head + mark + (_zigzag(len(rows)) + _zigzag(len(packed)) + packed + mark if rows else b"")


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def xlsx_of(sheet: str, rows: list[list], hidden_columns: tuple[int, ...] = (), hidden_rows: tuple[int, ...] = ()) -> bytes:
    """A workbook with one sheet; a cell is a number, a text, or (text, formula)."""

    def cell(r: int, c: int, v: object) -> str:
        at = f"{_column(c)}{r + 1}"
        if isinstance(v, tuple):
            return f'<c r="{at}"><f>{escape(v[1])}</f><v>{v[0]}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main, kind = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cols = "".join(f'<col min="{c + 1}" max="{c + 1}" hidden="1"/>' for c in hidden_columns)
    body = "".join(f'<row r="{r + 1}"{" hidden=" + chr(34) + "1" + chr(34) if r in hidden_rows else ""}>' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    return zip_of(
        [
            ("[Content_Types].xml", b"<Types/>"),
            ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>'.encode()),
            ("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'.encode()),
            ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}">{"<cols>" + cols + "</cols>" if cols else ""}<sheetData>{body}</sheetData></worksheet>'.encode()),
        ]
    )


def docx_of(paragraphs: list[str]) -> bytes:
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return zip_of([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", f'<w:document xmlns:w="{name}"><w:body>{body}</w:body></w:document>'.encode())])


def pdf_of(lines: list[str]) -> bytes:
    shown = " 0 -12 Td ".join("(" + s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj" for s in lines)
    stream = zlib.compress(f"BT /F1 12 Tf 72 720 Td {shown} ET".encode("latin-1", "replace"))
    return b"%PDF-1.4\n1 0 obj\n<</Type/Catalog>>\nendobj\n2 0 obj\n<</Filter/FlateDecode/Length " + str(len(stream)).encode() + b">>\nstream\n" + stream + b"\nendstream\nendobj\ntrailer<</Root 1 0 R>>\n%%EOF"


def rtf_of(paragraphs: list[str]) -> bytes:
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}" + "".join(p.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}") + "\\par\n" for p in paragraphs) + "}").encode("ascii", "replace")


def wave_of(values: list[int], rate: int = 8000) -> bytes:
    """One channel of 16 bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(2), file.setframerate(rate)
        file.writeframes(struct.pack(f"<{len(values)}h", *values))
    return out.getvalue()


def png_of(texts: list[tuple[str, str]], width: int = 1, height: int = 1) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    words = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in texts)
    return b"\x89PNG\r\n\x1a\n" + head + words + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


def cfb_of(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors; streams under 4096 bytes stand in the small stream."""
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    body: list[bytes] = []  # sectors after those of the table
    chains: list[tuple[int, int]] = []  # first sector and count of each chain
    pad = lambda data, n: data + b"\0" * (-len(data) % n)

    def add(data: bytes) -> int:
        if not data:
            return end
        first, whole = len(body), pad(data, 512)
        body.extend(whole[k : k + 512] for k in range(0, len(whole), 512))
        chains.append((first, len(body) - first))
        return first

    small, mini_table, places = b"", [], {}
    for name, data in streams.items():
        if len(data) < 4096:
            first, n = len(mini_table), -(-len(data) // 64)
            mini_table += [*range(first + 1, first + n), end] if n else []
            small += pad(data, 64)
            places[name] = (first if n else end, len(data))
        else:
            places[name] = (add(data), len(data))
    small_at = add(small)
    table_at = add(struct.pack(f"<{len(mini_table)}I", *mini_table))

    def entry(name: str, kind: int, child: int, right: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16le") + b"\0\0"
        return struct.pack("<64sHBB3I36xIQ", raw, len(raw), kind, 1, free, right, child, start, size)

    names = sorted(places, key=lambda n: (len(n), n.upper()))
    entries = [entry("Root Entry", 5, 1 if names else free, free, small_at, len(small))]
    entries += [entry(n, 2, free, k + 2 if k + 1 < len(names) else free, *places[n]) for k, n in enumerate(names)]
    directory = add(b"".join(entries))
    fat = 1
    while fat * 128 < len(body) + fat:
        fat += 1
    words = [0xFFFFFFFD] * fat + [free] * (fat * 128 - fat)
    for first, n in chains:
        for k in range(n):
            words[fat + first + k] = fat + first + k + 1 if k + 1 < n else end
    moved = lambda at: at if at == end else at + fat
    fixed = [bytearray(b) for b in body]
    for k in range(len(entries)):  # places in the directory were counted without the table's sectors
        sector, at = fixed[directory + k // 4], k % 4 * 128 + 116
        start, size = struct.unpack_from("<II", sector, at)
        if k == 0 or size >= 4096:
            struct.pack_into("<I", sector, at, moved(start))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6)
    head += struct.pack("<IIIIIIIIII", 0, fat, directory + fat, 0, 4096, moved(table_at), -(-len(mini_table) * 4 // 512), end, 0, 0)[:36]
    table = [*range(fat), *[free] * (109 - fat)]
    return (head + struct.pack("<109I", *table)).ljust(512, b"\0") + struct.pack(f"<{len(words)}I", *words) + b"".join(map(bytes, fixed))


def doc_of(paragraphs: list[str], wide: bool = False, pieces: int = 3) -> bytes:
    """A document whose text stands in several pieces, which the table names in order."""
    text = "".join(p + "\r" for p in paragraphs)
    cut = [len(text) * k // pieces for k in range(pieces + 1)]
    raw = text.encode("utf-16le" if wide else "cp1252")
    step, first = (2 if wide else 1), 0x400
    where = [first + step * c if wide else (first + c) * 2 | 0x40000000 for c in cut[:-1]]
    table = struct.pack(f"<{pieces + 1}I", *cut) + b"".join(struct.pack("<HIH", 0, w, 0) for w in where)
    head = bytearray(first)
    struct.pack_into("<HH", head, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", head, 10, 0x0200)
    struct.pack_into("<II", head, 0x18, first, first + len(raw))
    struct.pack_into("<I", head, 0x4C, len(text))
    struct.pack_into("<II", head, 0x1A2, 0, 5 + len(table))
    return cfb_of({"WordDocument": bytes(head) + raw, "1Table": b"\x02" + struct.pack("<I", len(table)) + table})


def ppt_of(slides: list[tuple[list[str], list[str]]]) -> bytes:
    """A presentation: for each slide the texts of its outline and those of its other shapes."""

    def record(kind: int, body: bytes, container: bool = False) -> bytes:
        return struct.pack("<HHI", 0xF if container else 0, kind, len(body)) + body

    def atom(text: str) -> bytes:
        plain = text.isascii()
        return record(4008, text.encode()) if plain else record(4000, text.encode("utf-16le"))

    outline = b"".join(record(1011, struct.pack("<I16x", k + 2)) + b"".join(map(atom, texts)) for k, (texts, _) in enumerate(slides))
    document = record(1000, record(4080, outline, True), True)
    main, places = document, [0]
    for _, shapes in slides:
        places.append(len(main))
        main += record(1006, b"".join(record(0xF00D, atom(t), True) for t in shapes), True)
    directory = len(main)
    main += record(6002, struct.pack(f"<I{len(places)}I", len(places) << 20 | 1, *places))
    edit = len(main)
    main += record(4085, struct.pack("<7I", 0, 0, 0, directory, 1, 0, 0))
    user = struct.pack("<HHIIII", 0, 4086, 12, 20, 0xE391C05F, edit)
    return cfb_of({"PowerPoint Document": main, "Current User": user})


def xls_of(sheets: list[tuple[str, int, list[list], tuple[int, ...], tuple[int, ...]]], new: bool = True) -> bytes:
    """A workbook of sheets (name, state, rows, hidden columns, hidden rows); a cell is a number, a text, or (number, formula tokens)."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    start = lambda kind: record(0x809, struct.pack("<HH12x", 0x600 if new else 0x500, kind))
    strings: list[str] = []

    def cell(r: int, c: int, v: object) -> bytes:
        at = struct.pack("<HHH", r, c, 0)
        if isinstance(v, tuple):
            return record(0x06, at + struct.pack("<dHIH", v[0], 0, 0, len(v[1])) + v[1])
        if isinstance(v, int) and abs(v) < 1 << 29:
            return record(0x27E, at + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
        if isinstance(v, (int, float)):
            return record(0x203, at + struct.pack("<d", v))
        if not new:
            return record(0x204, at + struct.pack("<H", len(v)) + v.encode("cp1252", "replace"))
        strings.append(v)
        return record(0xFD, at + struct.pack("<I", len(strings) - 1))

    bodies = []
    for _, _, rows, cols, hidden in sheets:
        body = start(0x10) + b"".join(record(0x7D, struct.pack("<6H", c, c, 2000, 0, 1, 0)) for c in cols)
        for r, row in enumerate(rows):
            body += record(0x208, struct.pack("<8H", r, 0, len(row), 255, 0, 0, 0x20 if r in hidden else 0, 0))
            body += b"".join(cell(r, c, v) for c, v in enumerate(row) if v != "")
        bodies.append(body + record(0x0A, b""))
    table, parts = struct.pack("<II", len(strings), len(strings)), []
    for s in strings:
        wide = not s.isascii()
        one = struct.pack("<HB", len(s), wide) + s.encode("utf-16le" if wide else "latin-1")
        if len(table) + len(one) > 8200:
            keep = max(3, min(len(one), 8200 - len(table)))
            keep -= (keep - 3) % 2 if wide else 0
            table += one[:keep]
            parts.append(table)
            table, one = (bytes([wide]) if len(one) > keep else b""), one[keep:]
        table += one
    parts.append(table)
    shared = (record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:])) if new else b""
    named = lambda n: struct.pack("<BB", len(n), 1) + n.encode("utf-16le") if new else struct.pack("<B", len(n)) + n.encode("cp1252")
    size = len(start(5)) + len(shared) + 4 + sum(4 + 6 + len(named(s[0])) for s in sheets)
    head, at = start(5), size
    for (name, state, *_), body in zip(sheets, bodies):
        head += record(0x85, struct.pack("<IBB", at, state, 0) + named(name))
        at += len(body)
    return cfb_of({"Workbook" if new else "Book": head + shared + record(0x0A, b"") + b"".join(bodies)})
