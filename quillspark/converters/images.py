"""Image headers and metadata: Exif, PNG text, XMP, IPTC and WebP chunks, as hidden rows of five columns."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from xml.parsers import expat

from quillspark.converters import hooks
from quillspark.converters.base import ConvertError, Outcome, Segment, has_meaning, normalize
from quillspark.plans import formats

Row = tuple[str, str, str, str | None, str]
#: Tags in the primary directory and in the GPS directory (fixed values).
EXIF = {
    270: "exif-imagedescription", 305: "exif-software", 306: "exif-datetime", 315: "exif-artist", 33432: "exif-copyright", 37510: "exif-usercomment",
    40091: "exif-xptitle", 40092: "exif-xpcomment", 40094: "exif-xpkeywords", 40095: "exif-xpsubject",
}
GPS = {1: "exif-gps-latituderef", 2: "exif-gps-latitude", 3: "exif-gps-longituderef", 4: "exif-gps-longitude", 29: "exif-gps-datestamp"}
XMP = {
    "title": ("xmp-dc-title", "dc:title"), "description": ("xmp-dc-description", "dc:description"), "subject": ("xmp-dc-subject", "dc:subject"),
    "creator": ("xmp-dc-creator", "dc:creator"), "rights": ("xmp-dc-rights", "dc:rights"), "CreatorTool": ("xmp-xmp-creatortool", "xmp:CreatorTool"),
    "Headline": ("xmp-photoshop-headline", "photoshop:Headline"),
}
IPTC = {5: "iptc-objectname", 25: "iptc-keywords", 80: "iptc-byline", 105: "iptc-headline", 120: "iptc-caption"}
MAX_AREA, LONG_EDGE, MAX_TEXT, MAX_EVENTS, MAX_XML_DEPTH = 2_359_296, 1600, 16 << 20, 100_000, 64


def bad(detail: str) -> ConvertError:
    return ConvertError("image-metadata-malformed", detail)


def exif_rows(raw: bytes) -> list[Row]:
    body = raw.removeprefix(b"Exif\0\0")
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(body[:4])
    if order is None:
        raise bad("unreadable exif")
    out: list[Row] = []

    def directory(at: int, names: dict[int, str], prefix: str, seen: set[int]) -> None:
        if at in seen or at + 2 > len(body):
            raise bad("unreadable exif directory")
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", body, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(body):
                raise bad("exif directory ends early")
            tag, kind, count = struct.unpack_from(order + "HHI", body, entry)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", body, entry + 8)[0]
            if tag == 0x8769 and not prefix:
                directory(struct.unpack_from(order + "I", body, entry + 8)[0], {37510: EXIF[37510]}, "", seen)
            elif tag == 0x8825 and not prefix:
                directory(struct.unpack_from(order + "I", body, entry + 8)[0], GPS, "gps:", seen)
            elif tag in names:
                if start + size > len(body):
                    raise bad("exif value lies outside")
                value = body[start : start + size]
                out.append(("exif", names[tag], f"{prefix}{tag}", None, shown(tag, kind, count, value)))

    def shown(tag: int, kind: int, count: int, value: bytes) -> str:
        if 40091 <= tag <= 40095:
            return value.decode("utf-16le", "replace").rstrip("\0")
        if tag == 37510:
            head, text = value[:8], value[8:]
            return (text.decode("utf-16", "replace") if head.startswith(b"UNICODE") else text.decode("utf-8", "replace")).rstrip("\0 ")
        if kind == 5:
            parts = [struct.unpack_from(order + "II", value, 8 * k) for k in range(count)]
            return " ".join(f"{a / b:g}" if b else "inf" for a, b in parts)
        return " ".join(p.decode("utf-8", "replace") for p in value.split(b"\0") if p) if kind == 2 else value.hex()

    try:
        directory(struct.unpack_from(order + "I", body, 4)[0], EXIF, "", set())
    except struct.error:
        raise bad("exif ends early") from None
    return out


def xmp_rows(text: str, carrier: str) -> list[Row]:
    """The properties above by local name; several runs of one are joined."""
    out: list[Row] = []
    state: dict = {"depth": 0, "open": None, "events": 0}

    def count() -> None:
        state["events"] += 1
        if state["events"] > MAX_EVENTS or state["depth"] > MAX_XML_DEPTH:
            raise ConvertError("image-metadata-xml-exceeded", "xmp is over a ceiling")

    def start(name: str, attributes: dict[str, str]) -> None:
        state["depth"] += 1
        count()
        for key, value in attributes.items():
            if (found := XMP.get(key.rpartition(":")[2])) and value.strip():
                out.append((carrier, *found, None, value))
        local = name.rpartition(":")[2]
        if state["open"] is None and local in XMP:
            state["open"] = {"at": state["depth"], "what": XMP[local], "runs": [""], "lang": None}
        elif state["open"]:
            state["open"]["runs"].append("")
            state["open"]["lang"] = attributes.get("xml:lang", state["open"]["lang"])

    def end(_: str) -> None:
        count()
        now = state["open"]
        if now:
            if now["at"] == state["depth"]:
                runs = [r.strip() for r in now["runs"] if r.strip()]
                if runs:
                    out.append((carrier, *now["what"], now["lang"], "; ".join(runs)))
                state["open"] = None
            else:
                now["runs"].append("")
        state["depth"] -= 1

    def characters(data: str) -> None:
        if state["open"]:
            state["open"]["runs"][-1] += data

    def refuse(*_: object) -> None:
        raise bad("xmp declares entities")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, characters, refuse
    try:
        parser.Parse(text.strip("\0 \r\n﻿"), True)
    except expat.ExpatError as e:
        raise bad(f"malformed xmp: {e}") from None
    return out


def iptc_rows(raw: bytes) -> list[Row]:
    """Datasets of record 2 in the photo resource 1028."""
    out, at = [], 0
    body = raw.removeprefix(b"Photoshop 3.0\0")
    while body[at : at + 4] == b"8BIM":
        kind, name = struct.unpack_from(">HB", body, at + 4)
        at += 6 + (name + 2) // 2 * 2
        size = struct.unpack_from(">I", body, at)[0]
        block, at = body[at + 4 : at + 4 + size], at + 4 + (size + 1) // 2 * 2
        k = 0
        while kind == 1028 and block[k : k + 1] == b"\x1c" and k + 5 <= len(block):
            record, dataset, length = struct.unpack_from(">BBH", block, k + 1)
            if length & 0x8000 or k + 5 + length > len(block):
                raise bad("iptc dataset lies outside")
            if record == 2 and dataset in IPTC:
                out.append(("iptc", IPTC[dataset], f"2:{dataset}", None, block[k + 5 : k + 5 + length].decode("utf-8", "replace")))
            k += 5 + length
    return out


def _limited(data: bytes) -> bytes:
    inflater = zlib.decompressobj()
    try:
        out = inflater.decompress(data, MAX_TEXT)
    except zlib.error as e:
        raise bad(f"bad compressed text: {e}") from None
    if inflater.unconsumed_tail:
        raise ConvertError("image-metadata-decompression-exceeded", f"text inflates over {MAX_TEXT} bytes")
    return out


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise bad("png ends before its end chunk")


def png_rows(data: bytes) -> list[Row]:
    out: list[Row] = []
    for kind, body in png_chunks(data):
        if kind == b"eXIf":
            out += exif_rows(body)
        elif kind == b"tEXt":
            key, _, text = body.partition(b"\0")
            out.append(("png-text", "png-text", key.decode("latin-1"), None, text.decode("latin-1")))
        elif kind == b"zTXt":
            key, _, rest = body.partition(b"\0")
            out.append(("png-ztext", "png-text", key.decode("latin-1"), None, _limited(rest[1:]).decode("latin-1")))
        elif kind == b"iTXt":
            key, _, rest = body.partition(b"\0")
            language, _, tail = rest[2:].partition(b"\0")
            text = tail.partition(b"\0")[2]
            shown = (_limited(text) if rest[:1] == b"\1" else text).decode("utf-8", "replace")
            if key == b"XML:com.adobe.xmp":
                out += xmp_rows(shown, "png-itxt-xmp")
            else:
                out.append(("png-itxt", "png-text", key.decode("latin-1"), language.decode("latin-1") or None, shown))
    return out


def jpeg_segments(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 0x01:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):
            return out
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise bad("jpeg segment lies outside")
        out.append((kind, data[at + 4 : at + 2 + size]))
        at += 2 + size
    return out


def jpeg_rows(data: bytes) -> list[Row]:
    out: list[Row] = []
    packets = 0
    for kind, body in jpeg_segments(data):
        if kind == 0xE1 and body.startswith(b"Exif\0"):
            out += exif_rows(body)
        elif kind == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            packets += 1
            if packets > 1:
                raise bad("more than one xmp packet")
            out += xmp_rows(body.partition(b"\0")[2].decode("utf-8", "replace"), "xmp")
        elif kind == 0xED:
            out += iptc_rows(body)
    return out


def webp_rows(data: bytes) -> list[Row]:
    out, at = [], 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise bad("webp chunk lies outside")
        if kind == b"EXIF":
            out += exif_rows(body)
        elif kind == b"XMP ":
            out += xmp_rows(body.decode("utf-8", "replace"), "xmp")
        at += 8 + size + size % 2
    return out


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise bad("heic box lies outside")
        yield kind, start + head, start + size
        start += size


def _items(data: bytes, start: int, end: int) -> dict[int, tuple[bytes, bytes]]:
    """Type and content type of the items that an item information box lists."""
    at = start + 4 + (2 if data[start] == 0 else 4)
    out = {}
    for kind, a, _b in _boxes(data, at, end):
        if kind == b"infe" and data[a] >= 2:
            wide = data[a] > 2
            number = struct.unpack_from(">I" if wide else ">H", data, a + 4)[0]
            b = a + 4 + (4 if wide else 2) + 2
            rest = data[b + 4 : _b].split(b"\0")
            out[number] = (data[b : b + 4], rest[1] if len(rest) > 1 else b"")
    return out


def _places(data: bytes, start: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """How each item is stored, and the (offset, length) of its parts."""
    version, sizes = data[start], struct.unpack_from(">H", data, start + 4)[0]
    widths = [sizes >> 12 & 15, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0]
    at = start + 6

    def number(width: int) -> int:
        nonlocal at
        if at + width > len(data):
            raise bad("heic item lies outside")
        at += width
        return int.from_bytes(data[at - width : at], "big")

    out = {}
    for _ in range(number(2 if version < 2 else 4)):
        item = number(2 if version < 2 else 4)
        method = number(2) & 15 if version else 0
        number(2)
        base = number(widths[2])
        parts = []
        for _ in range(number(2)):
            number(widths[3])
            offset, length = number(widths[0]), number(widths[1])
            parts.append((base + offset, length))
        out[item] = (method, parts)
    return out


def heic_rows(data: bytes) -> list[Row]:
    """What the exif and xmp items of the meta box hold."""
    out: list[Row] = []
    packets = 0
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        inner = {k: (x, y) for k, x, y in _boxes(data, a + 4, b)}
        if b"iinf" not in inner or b"iloc" not in inner:
            continue
        items, places = _items(data, *inner[b"iinf"]), _places(data, inner[b"iloc"][0])
        for item, (sort, content) in sorted(items.items()):
            is_xmp = sort == b"mime" and content == b"application/rdf+xml"
            if sort != b"Exif" and not is_xmp:
                continue
            method, parts = places.get(item, (0, []))
            shift = inner[b"idat"][0] if method == 1 and b"idat" in inner else 0
            body = b"".join(data[shift + o : shift + o + n] for o, n in parts)
            if sum(n for _, n in parts) != len(body) or method > 1:
                raise bad("heic item lies outside")
            if is_xmp:
                packets += 1
                if packets > 1:
                    raise bad("more than one xmp packet")
                out += xmp_rows(body.decode("utf-8", "replace"), "xmp")
            elif len(body) > 4:
                out += exif_rows(b"Exif\0\0" + body[4 + struct.unpack_from(">I", body)[0] :])
    return out


def dimensions(data: bytes, fmt: str) -> tuple[int, int]:
    """Width and height from the header alone."""
    try:
        if fmt == "png":
            return struct.unpack_from(">II", data, 16)
        if fmt == "webp":
            kind = data[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = struct.unpack_from("<I", data, 21)[0]
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack_from("<HH", data, 26)
            return w & 0x3FFF, h & 0x3FFF
        for kind, body in jpeg_segments(data):
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", body, 1)
                return w, h
    except struct.error:
        pass
    raise ConvertError("image-ocr-malformed", "no readable image header")


def preflight(data: bytes, fmt: str) -> list[str]:
    """Warnings of an image that may be recognised; raises if its area is over the ceiling."""
    width, height = dimensions(data, fmt)
    if width * height > MAX_AREA:
        raise ConvertError("image-ocr-area-exceeded", f"{width} x {height} is over {MAX_AREA} pixels")
    edge = max(width, height)
    return [f"image_ocr_long_edge: {edge} is over {LONG_EDGE}"] if edge > LONG_EDGE else []


#: Below this confidence of any line a warning is given.
CONFIDENT = 0.5


def recognise(data: bytes, fmt: str) -> Outcome:
    """The lines that an engine reads; without one an image's pixels stay unread, and the record says so."""
    warnings = preflight(data, fmt)
    engine = hooks.engine("recognition")
    if engine is None:
        raise ConvertError("image-ocr-runtime-missing", "no recognition engine is installed")
    lines = [(normalize(t).replace("\n", " ").strip(), c) for t, c in engine(data, fmt)]
    lines = [(t, c) for t, c in lines if t]
    text, segments = "", []
    for line, _ in lines:
        at = len(text.encode())
        segments.append(Segment("span", at, at + len(line.encode()), "ocr"))
        text += line + "\n"
    if not has_meaning(text):
        raise ConvertError("image-ocr-no-text", "the engine read nothing")
    low = sum(c < CONFIDENT for _, c in lines)
    warnings += [f"image_ocr_low_confidence: {low} of {len(lines)} lines"] if low else []
    return Outcome(text, "image-pixel-ocr", warnings, segments, "ocr")


def escape_field(raw: str) -> str:
    plain = {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\n": "\\n", "\r": "\\r"}
    return "".join(plain.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in unicodedata.normalize("NFC", raw))


def metadata(data: bytes, fmt: str) -> Outcome | None:
    """The metadata artifact, or None if there is nothing to show."""
    readers = {"png": png_rows, "jpeg": jpeg_rows, "webp": webp_rows, "heic": heic_rows}
    if fmt not in readers:
        return None
    try:
        rows = [r for r in readers[fmt](data) if r[4].strip()]
    except (struct.error, IndexError) as e:
        raise bad(str(e)) from None
    if not rows:
        return None
    lines, segments, at = [], [], 0
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or "", r[4])):
        line = "\t".join(escape_field(f or "") for f in row)
        size = len(line.encode())
        segments.append(Segment("span", at, at + size, "metadata", hidden=True))
        lines.append(line + "\n")
        at += size + 1
    if at > formats.MAX_OUTPUT:
        raise ConvertError("resource_limit", f"text exceeds {formats.MAX_OUTPUT} bytes")
    return Outcome("".join(lines), "image-metadata", [], segments)
