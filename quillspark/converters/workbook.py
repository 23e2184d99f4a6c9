"""Workbooks (xlsx, xlsm, ods, xls) to text, with what is hidden marked."""

from __future__ import annotations

import posixpath
import re
import struct
import unicodedata
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from quillspark.converters.archive import opened
from quillspark.converters.base import ConvertError, Outcome, Segment
from quillspark.converters.records import number
from quillspark.plans import formats


@dataclass
class Sheet:
    name: str
    hidden: bool = False
    cells: dict[tuple[int, int], str] = field(default_factory=dict)
    formulas: dict[tuple[int, int], str] = field(default_factory=dict)
    hidden_rows: list[tuple[int, int]] = field(default_factory=list)
    hidden_cols: list[tuple[int, int]] = field(default_factory=list)

    def put(self, row: int, col: int, value: str, formula: str | None = None) -> None:
        if row >= formats.MAX_ROWS or col >= formats.MAX_COLUMNS:
            raise ConvertError("resource_limit", "a cell lies outside the largest sheet")
        if value:
            self.cells[row, col] = value
        if formula:
            self.formulas[row, col] = formula


def piece(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\n", " ").replace("\t", " ")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        with archive.open(name) as file:
            data = file.read(formats.MAX_PART + 1)
        if len(data) > formats.MAX_PART:
            raise ConvertError("resource_limit", f"{name} exceeds {formats.MAX_PART} bytes")
        if b"<!ENTITY" in data:
            raise ConvertError("workbook_parse_error", "entity declarations are refused")
        return ElementTree.fromstring(data)
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError) as e:
        raise ConvertError("workbook_parse_error", f"{name}: {e}") from None


def cell_position(reference: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6})", reference)
    if not m:
        raise ConvertError("workbook_parse_error", f"cell reference {reference!r}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _text(node: ElementTree.Element) -> str:
    """The text runs of a shared or inline string, without phonetic ones."""
    return "".join(t.text or "" for child in node for t in ([child] if _local(child.tag) == "t" else [g for g in child if _local(g.tag) == "t"] if _local(child.tag) == "r" else []))


def xlsx(data: bytes) -> list[Sheet]:
    archive = opened(data)
    names = set(archive.namelist())
    book = _xml(archive, "xl/workbook.xml")
    relations = {r.get("Id"): (r.get("Target", ""), r.get("Type", "")) for r in _xml(archive, "xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    shared = [_text(s) for s in _xml(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    out = []
    for entry in (n for n in book.iter() if _local(n.tag) == "sheet"):
        target, kind = relations.get(_attribute(entry, "id"), ("", ""))
        if not kind.endswith("/worksheet"):
            continue
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        sheet = Sheet(entry.get("name", ""), entry.get("state", "visible") != "visible")
        for node in _xml(archive, path).iter():
            tag = _local(node.tag)
            if tag == "col" and (_true(node.get("hidden")) or node.get("width") == "0"):
                sheet.hidden_cols.append((int(node.get("min", "1")) - 1, int(node.get("max", "1")) - 1))
            elif tag == "row":
                row = int(node.get("r", "0")) - 1
                if _true(node.get("hidden")) or node.get("ht") == "0":
                    sheet.hidden_rows.append((row, row))
            elif tag == "c":
                row, col = cell_position(node.get("r", ""))
                parts = {_local(p.tag): p for p in node}
                value = parts["v"].text or "" if "v" in parts else ""
                match node.get("t", "n"):
                    case "s":
                        value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                    case "inlineStr":
                        value = _text(parts["is"]) if "is" in parts else ""
                    case "b":
                        value = {"1": "true", "0": "false"}.get(value, value)
                    case "n" if value:
                        value = number(float(value)) if re.fullmatch(r"[-+]?[0-9.]+([eE][-+]?[0-9]+)?", value) else value
                sheet.put(row, col, piece(value), piece(parts["f"].text or "") if "f" in parts else None)
        out.append(sheet)
    return out


def _true(value: str | None) -> bool:
    return value in ("1", "true")


def ods(data: bytes) -> list[Sheet]:
    archive = opened(data)
    content = _xml(archive, "content.xml")
    off = {_attribute(s, "name") for s in content.iter() if _local(s.tag) == "style" and any(_attribute(p, "display") == "false" for p in s)}
    zero = {_attribute(s, "name") for s in content.iter() if _local(s.tag) == "style" and any((_attribute(p, k) or "").rstrip("cminptx") in ("0", "0.0") for p in s for k in ("row-height", "column-width"))}
    out = []
    for table in (n for n in content.iter() if _local(n.tag) == "table"):
        sheet = Sheet(_attribute(table, "name") or "", _attribute(table, "style-name") in off)
        row = col = 0
        for node in _rows(table):
            repeat = int(_attribute(node, "number-columns-repeated" if _local(node.tag) == "table-column" else "number-rows-repeated") or 1)
            hidden = _attribute(node, "visibility") in ("collapse", "filter") or _attribute(node, "style-name") in zero
            if _local(node.tag) == "table-column":
                if hidden:
                    sheet.hidden_cols.append((col, col + repeat - 1))
                col += repeat
                continue
            if hidden:
                sheet.hidden_rows.append((row, row + repeat - 1))
            at, found = 0, []
            for cell in node:
                if _local(cell.tag) in ("table-cell", "covered-table-cell"):
                    times = int(_attribute(cell, "number-columns-repeated") or 1)
                    text = "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p")
                    kind, raw = _attribute(cell, "value-type"), _attribute(cell, "value")
                    shown = number(float(raw)) if kind == "float" and raw else text
                    formula = _attribute(cell, "formula")
                    if shown or formula:
                        found += [(at + k, piece(shown), piece(re.sub(r"^\w+:=?|^=", "", formula)) if formula else None) for k in range(min(times, formats.MAX_COLUMNS))]
                    at += times
            if found:
                if repeat * len(found) > formats.MAX_CELLS:
                    raise ConvertError("resource_limit", "repeated rows exceed the largest sheet")
                for k in range(repeat):
                    for c, value, formula in found:
                        sheet.put(row + k, c, value, formula)
            row += repeat
        out.append(sheet)
    return out


def _rows(table: ElementTree.Element) -> list[ElementTree.Element]:
    """Rows and columns in order, those in groups and headers too."""
    out = []
    for node in table:
        if _local(node.tag) in ("table-row", "table-column"):
            out.append(node)
        elif _local(node.tag) in ("table-row-group", "table-header-rows", "table-rows", "table-column-group", "table-header-columns", "table-columns"):
            out += _rows(node)
    return out


def _inside(ranges: list[tuple[int, int]], x: int) -> bool:
    return any(a <= x <= b for a, b in ranges)


def render(sheets: list[Sheet]) -> Outcome:
    parts: list[str] = []
    segments: list[Segment] = []
    size = 0

    def write(text: str) -> None:
        nonlocal size
        parts.append(text)
        size += len(text.encode())
        if size > formats.MAX_OUTPUT:
            raise ConvertError("resource_limit", f"text exceeds {formats.MAX_OUTPUT} bytes")

    for sheet in sheets:
        if size:
            write("\n")
        start = size
        used = sheet.cells.keys() | sheet.formulas.keys()
        rows: dict[int, list[int]] = {}
        for r, c in used:
            rows.setdefault(r, []).append(c)
        if used:
            left, top, bottom = min(c for _, c in used), min(rows), max(rows)
            if (bottom - top + 1) * (max(c for _, c in used) - left + 1) > formats.MAX_CELLS:
                raise ConvertError("resource_limit", f"a sheet spans more than {formats.MAX_CELLS} cells")
            for r in range(top, bottom + 1):
                line = size
                for c in range(left, max(rows.get(r, [left - 1])) + 1):
                    if c > left:
                        write("\t")
                    at = size
                    value, formula = sheet.cells.get((r, c), ""), sheet.formulas.get((r, c))
                    write(value if formula is None else f"{value} [={formula}]" if value else f"[={formula}]")
                    if _inside(sheet.hidden_cols, c):
                        segments.append(Segment("span", at, size, "column", hidden=True))
                write("\n")
                if _inside(sheet.hidden_rows, r):
                    segments.append(Segment("span", line, size - 1, "row", hidden=True))
        segments += [Segment("sheet", start, start, "sheet", sheet.name), Segment("span", start, size, "sheet", sheet.name, sheet.hidden)]
    return Outcome("".join(parts), "workbook-ir", [], sorted(segments, key=lambda s: (s.start, s.end)))


def convert(data: bytes, fmt: str) -> Outcome:
    if fmt not in ("xlsx", "xlsm", "ods", "xls"):
        raise ConvertError("unclaimed_format", f"the workbook converter does not handle {fmt}")
    if fmt == "xls":
        return _legacy(data)
    try:
        out = render(ods(data) if fmt == "ods" else xlsx(data))
    except ValueError as e:
        raise ConvertError("workbook_parse_error", str(e)) from None
    return _with_text(out, data)


def _with_text(out: Outcome, data: bytes) -> Outcome:
    if data and not out.text:
        raise ConvertError("empty_output", f"source is {len(data)} bytes but conversion produced no text")
    return out


def _legacy(data: bytes) -> Outcome:
    """A legacy workbook, its values compared with those of a second extraction."""
    from quillspark.converters import biff, differential

    try:
        sheets, warnings = biff.xls(data)
    except struct.error as e:
        raise ConvertError("workbook_parse_error", str(e)) from None
    out = _with_text(render(sheets), data)
    values = "\n".join(v for s in sheets for _, v in sorted(s.cells.items()))
    out.warnings += warnings + differential.check(values, data, "xls")
    return out
