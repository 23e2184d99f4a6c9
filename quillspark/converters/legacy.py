"""Legacy Office files: the compound file that holds their streams, and the text of doc, ppt and xls.

Each format has two ways in. The first follows the file's own tables (pieces, persist directory, sheet offsets); the
second only scans the stream, so that the two can be compared.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from quillspark.converters.base import ConvertError

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
#: Sector numbers from here on mean something else (fixed values).
NO_SECTOR, END = 0xFFFFFFFA, 0xFFFFFFFE


class CompoundFile:
    """Streams of the top folder, by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ConvertError("malformed", "no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ConvertError("malformed", "sector size")
        self.size = 1 << shift
        self.most = len(data) // self.size + 1
        directory, _, self.cutoff, mini, _, more, more_count = struct.unpack_from("<7I", data, 48)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < NO_SECTOR]
        for _ in range(min(more_count, self.most)):
            if more >= NO_SECTOR:
                break
            words = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            sectors += [s for s in words[:-1] if s < NO_SECTOR]
            more = words[-1]
        self.table = [w for s in sectors for w in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = self._chain(directory)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries) - 127, 128)]
        if not self.entries:
            raise ConvertError("malformed", "no directory")
        mini_table = self._chain(mini) if mini < NO_SECTOR else b""
        self.mini_table = struct.unpack(f"<{len(mini_table) // 4}I", mini_table)
        start, size = struct.unpack_from("<II", self.entries[0], 116)
        self.mini = self._chain(start)[:size] if start < NO_SECTOR else b""
        self.names = dict(self._top())

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        part = self.data[at : at + self.size]
        if not part:
            raise ConvertError("malformed", f"sector {number} lies outside the file")
        return part.ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], 0
        while start < NO_SECTOR:
            out.append(self._sector(start))
            seen += 1
            if seen > self.most or start >= len(self.table):
                raise ConvertError("malformed", "a chain of sectors has no end")
            start = self.table[start]
        return b"".join(out)

    def _top(self) -> Iterator[tuple[str, bytes]]:
        """The entries of the root's tree of siblings."""
        todo, seen = [struct.unpack_from("<I", self.entries[0], 76)[0]], set()
        while todo:
            k = todo.pop()
            if k in seen or k >= len(self.entries):
                continue
            seen.add(k)
            entry = self.entries[k]
            size = min(struct.unpack_from("<H", entry, 64)[0], 64)
            todo += struct.unpack_from("<II", entry, 68)
            if entry[66] == 2:
                yield entry[: max(0, size - 2)].decode("utf-16le", "replace"), entry

    def stream(self, name: str) -> bytes | None:
        entry = self.names.get(name)
        if entry is None:
            return None
        start, size = struct.unpack_from("<II", entry, 116)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], 0
        while start < NO_SECTOR:
            out.append(self.mini[start * 64 : start * 64 + 64])
            seen += 1
            if seen > len(self.mini_table) or start >= len(self.mini_table):
                raise ConvertError("malformed", "a chain of small sectors has no end")
            start = self.mini_table[start]
        return b"".join(out)[:size]


def _stream(data: bytes, *names: str) -> tuple[CompoundFile, bytes]:
    file = CompoundFile(data)
    for name in names:
        found = file.stream(name)
        if found is not None:
            return file, found
    raise ConvertError("missingPart", names[0])


# --- doc -----------------------------------------------------------------------------------------------------------


def _shown(raw: str) -> str:
    """Paragraphs of a document's characters: fields show their results, cells are tabs, marks of objects nothing."""
    out, fields = [], []
    for c in raw:
        if c == "\x13":
            fields.append(True)
        elif c == "\x14":
            if fields:
                fields[-1] = False
        elif c == "\x15":
            if fields:
                fields.pop()
        elif not any(fields):
            out.append(c)
    text = re.sub("\x07\x07", "\r", "".join(out)).replace("\x07", "\t")  # a row's last cell ends with two marks
    text = text.translate({0x0B: "\n", 0x0C: "\r", 0x0E: "\r", 0x1E: "-", 0x1F: None, 0xAD: None} | {c: None for c in (*range(1, 9), *range(0x10, 0x1D))})
    return "\n\n".join(p.strip(" \t\n") for p in text.split("\r") if p.strip())


def doc(data: bytes) -> str:
    """The main text and the notes after it, by the table of pieces."""
    file, main = _stream(data, "WordDocument")
    if len(main) < 0x60 or struct.unpack_from("<H", main)[0] not in (0xA5EC, 0xA5DC):
        raise ConvertError("malformed", "no document header")
    version, flags = struct.unpack_from("<H", main, 2)[0], struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ConvertError("encrypted", "the document is encrypted")
    if version < 0xC1:  # older files keep their text in one run
        first, size = struct.unpack_from("<I", main, 0x18)[0], struct.unpack_from("<I", main, 0x34)[0]
        return _shown(main[first : first + size].decode("cp1252", "replace"))
    if len(main) < 0x1AA:
        raise ConvertError("malformed", "the document header is cut")
    table = file.stream("1Table" if flags & 0x0200 else "0Table")
    if table is None:
        raise ConvertError("missingPart", "table stream")
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx = table[at : at + size]
    place = 0
    while place < len(clx) and clx[place] == 1:
        place += 3 + struct.unpack_from("<H", clx, place + 1)[0]
    if place + 5 > len(clx) or clx[place] != 2:
        raise ConvertError("malformed", "no table of pieces")
    length = struct.unpack_from("<I", clx, place + 1)[0]
    pieces = clx[place + 5 : place + 5 + length]
    count = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{count + 1}I", pieces)
    total = sum(struct.unpack_from("<8I", main, 0x4C)) - struct.unpack_from("<I", main, 0x54)[0]  # without headers and footers
    text, header = [], struct.unpack_from("<3I", main, 0x4C)
    for k in range(count):
        where = struct.unpack_from("<I", pieces, 4 * (count + 1) + 8 * k + 2)[0]
        n = ends[k + 1] - ends[k]
        if n < 0 or n > len(main):
            raise ConvertError("malformed", "a piece has no length")
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            text.append(main[start : start + n].decode("cp1252", "replace"))
        else:
            text.append(main[where : where + 2 * n].decode("utf-16le", "replace"))
    whole = "".join(text)
    body = whole[: header[0] + header[1]] + whole[header[0] + header[1] + header[2] : total + header[2]]
    return _shown(body)


def doc_scan(data: bytes) -> str:
    """The run of text between the first and the last character that the header names, without the table of pieces."""
    _, main = _stream(data, "WordDocument")
    first, last = struct.unpack_from("<II", main, 0x18)
    run = main[first:last]
    wide = len(run) > 1 and run[1::2].count(0) > len(run) // 4
    return _shown(run.decode("utf-16le" if wide else "cp1252", "replace"))


# --- ppt -----------------------------------------------------------------------------------------------------------

#: Record types (fixed values).
DOCUMENT, SLIDE, LIST, PERSIST_ATOM, CHARS, BYTES, EDIT, DIRECTORY = 1000, 1006, 4080, 1011, 4000, 4008, 4085, 6002


def _records(data: bytes, start: int, end: int, depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(type, instance, start, end) of the records between two places."""
    if depth > 32:
        raise ConvertError("malformed", "records are nested too deep")
    while start + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, start)
        stop = min(start + 8 + size, end)
        yield kind, head >> 4, start + 8, stop
        start = stop


def _is_container(data: bytes, start: int) -> bool:
    return data[start - 8] & 0xF == 0xF


def _texts(data: bytes, start: int, end: int, depth: int = 0) -> Iterator[tuple[int, str]]:
    """(place, text) of all text atoms, at any depth."""
    for kind, _, a, b in _records(data, start, end, depth):
        if kind == CHARS:
            yield a, data[a:b].decode("utf-16le", "replace")
        elif kind == BYTES:
            yield a, data[a:b].decode("latin-1")
        elif _is_container(data, a):
            yield from _texts(data, a, b, depth + 1)


def _slide_text(parts: list[str]) -> str:
    lines = [x.strip() for p in parts for x in p.replace("\x0b", "\n").split("\r")]
    return "\n\n".join(x for x in lines if x)


def ppt(data: bytes) -> str:
    """Slides in their order: what the outline holds of a slide, then its other shapes, by the newest persist directory."""
    file, main = _stream(data, "PowerPoint Document")
    current = file.stream("Current User")
    if current is None or len(current) < 20:
        raise ConvertError("missingPart", "Current User")
    if struct.unpack_from("<I", current, 12)[0] == 0xF3D1C4DF:
        raise ConvertError("encrypted", "the presentation is encrypted")
    edit, places, seen, document = struct.unpack_from("<I", current, 16)[0], {}, set(), None
    while edit and edit not in seen and edit + 36 <= len(main):
        seen.add(edit)
        if struct.unpack_from("<H", main, edit + 2)[0] != EDIT:
            raise ConvertError("malformed", "no record of edits")
        _, _, before, directory, reference = struct.unpack_from("<5I", main, edit + 8)
        document = reference if document is None else document
        if directory + 8 > len(main) or struct.unpack_from("<H", main, directory + 2)[0] != DIRECTORY:
            raise ConvertError("malformed", "no persist directory")
        at, end = directory + 8, min(directory + 8 + struct.unpack_from("<I", main, directory + 4)[0], len(main))
        while at + 4 <= end:
            word = struct.unpack_from("<I", main, at)[0]
            for k in range(min(word >> 20, (end - at - 4) // 4)):
                places.setdefault((word & 0xFFFFF) + k, struct.unpack_from("<I", main, at + 4 + 4 * k)[0])
            at += 4 + 4 * (word >> 20)
        edit = before
    start = places.get(document or 0)
    if start is None or start + 8 > len(main) or struct.unpack_from("<H", main, start + 2)[0] != DOCUMENT:
        raise ConvertError("malformed", "no document record")
    out = []
    for kind, instance, a, b in _records(main, start + 8, min(start + 8 + struct.unpack_from("<I", main, start + 4)[0], len(main))):
        if kind != LIST or instance != 0:
            continue
        slides: list[tuple[int, list[str]]] = []
        for inner, _, x, y in _records(main, a, b):
            if inner == PERSIST_ATOM and x + 4 <= y:
                slides.append((struct.unpack_from("<I", main, x)[0], []))
            elif inner in (CHARS, BYTES) and slides:
                slides[-1][1].append(main[x:y].decode("utf-16le" if inner == CHARS else "latin-1", "replace"))
        for reference, texts in slides:
            at = places.get(reference)
            if at is not None and at + 8 <= len(main) and struct.unpack_from("<H", main, at + 2)[0] == SLIDE:
                texts += [t for _, t in _texts(main, at + 8, min(at + 8 + struct.unpack_from("<I", main, at + 4)[0], len(main)))]
            out.append(_slide_text(texts))
    return "\n\n".join(t for t in out if t)


def ppt_scan(data: bytes) -> str:
    """All text atoms of slides and of the first list of slides, in the order of the stream."""
    _, main = _stream(data, "PowerPoint Document")
    found = []
    for kind, _, a, b in _records(main, 0, len(main)):
        if kind == SLIDE:
            found += list(_texts(main, a, b))
        elif kind == DOCUMENT:
            found += [t for inner, instance, x, y in _records(main, a, b) if inner == LIST and instance == 0 for t in _texts(main, x, y)]
    return _slide_text([t for _, t in sorted(found)])
