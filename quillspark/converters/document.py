"""Office documents, books and rich text to plain text; and markdown to plain text."""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree

from quillspark.converters import differential, legacy
from quillspark.converters.archive import opened
from quillspark.converters.base import ConvertError, Outcome, Segment, normalize
from quillspark.converters.html import strip_html
from quillspark.plans import formats


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _part(archive: zipfile.ZipFile, name: str) -> bytes:
    try:
        with archive.open(name) as file:
            data = file.read(formats.MAX_PART + 1)
    except KeyError:
        raise ConvertError("missingPart", name) from None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
        raise ConvertError("encrypted" if "encrypt" in str(e) else "malformed", f"{name}: {e}") from None
    if len(data) > formats.MAX_PART:
        raise ConvertError("resourceLimit", f"{name} exceeds {formats.MAX_PART} bytes")
    return data


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ConvertError("malformed", "entity declarations are refused")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ConvertError("malformed", str(e)) from None


def blocks_of(node: ElementTree.Element) -> list[str]:
    """Paragraphs and table rows of a word-processing, presentation or open-document tree, in order."""
    out: list[str] = []

    def inline(n: ElementTree.Element) -> str:
        tag = _local(n.tag)
        if tag in ("del", "moveFrom", "instrText", "tracked-changes", "annotation", "fldChar"):
            return ""
        if tag in ("t", "span") or (tag in ("p", "h", "a") and n.text):
            text = n.text or ""
        elif tag in ("tab",):
            text = "\t"
        elif tag in ("br", "cr", "line-break"):
            text = "\n"
        elif tag == "s":
            count = next((v for k, v in n.attrib.items() if _local(k) == "c"), "1")
            text = " " * int(count) if count.isdigit() else " "
        else:
            text = ""
        open_document = "opendocument" in n.tag if isinstance(n.tag, str) else False
        return text + "".join(inline(c) + ((c.tail or "") if open_document else "") for c in n)

    def visit(n: ElementTree.Element) -> None:
        tag = _local(n.tag)
        if tag in ("tbl", "table"):
            for row in (r for r in n.iter() if _local(r.tag) in ("tr", "table-row")):
                cells = [" ".join(blocks_of(c)) for c in row if _local(c.tag) in ("tc", "table-cell")]
                out.append("\t".join(cells).rstrip("\t"))
        elif tag in ("p", "h"):
            out.append(inline(n))
        else:
            for c in n:
                visit(c)

    for child in node:
        visit(child)
    return [b for b in out if b.strip()]


def docx(data: bytes) -> str:
    archive = opened(data)
    names = archive.namelist()
    parts = ["word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/(footnotes|endnotes|comments)\.xml", n))]
    return "\n\n".join(b for p in parts for b in blocks_of(_tree(_part(archive, p))))


def pptx(data: bytes) -> str:
    archive = opened(data)
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return "\n\n".join(b for s in slides for b in blocks_of(_tree(_part(archive, s))))


def open_document(data: bytes) -> str:
    body = _tree(_part(opened(data), "content.xml"))
    return "\n\n".join(blocks_of(next((n for n in body.iter() if _local(n.tag) == "body"), body)))


def epub(data: bytes) -> str:
    archive = opened(data)
    root = _tree(_part(archive, "META-INF/container.xml"))
    path = next((n.get("full-path") for n in root.iter() if _local(n.tag) == "rootfile"), None)
    if not path:
        raise ConvertError("malformed", "no root file")
    package = _tree(_part(archive, path))
    items = {n.get("id"): n.get("href", "") for n in package.iter() if _local(n.tag) == "item"}
    spine = [items[i] for n in package.iter() if _local(n.tag) == "itemref" and (i := n.get("idref")) in items]
    base = posixpath.dirname(path)
    texts = [strip_html(_part(archive, posixpath.normpath(posixpath.join(base, h))).decode("utf-8", "replace")).strip("\n") for h in spine]
    return "\n\n".join(t for t in texts if t)


#: Groups of rich text that show nothing (fixed values).
_SILENT = frozenset("fonttbl colortbl stylesheet info pict object themedata datastore listtable listoverridetable rsidtbl generator xmlnstbl header footer".split())
_RTF = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(data: bytes) -> str:
    if data[:5] != b"{\\rtf":
        raise ConvertError("malformed", "no rich text header")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip_after, pending, page = False, 1, 0, "cp1252"

    def show(text: str) -> None:
        nonlocal pending
        if not silent:
            cut = min(pending, len(text))
            pending -= cut
            out.append(text[cut:])

    for m in _RTF.finditer(data):
        word, argument, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append((silent, skip_after))
        elif brace == b"}":
            if stack:
                silent, skip_after = stack.pop()
        elif word:
            name = word.decode()
            if name in _SILENT:
                silent = True
            elif name in ("par", "line", "row"):
                show("\n")
            elif name in ("tab", "cell"):
                show("\t")
            elif name == "uc":
                skip_after = int(argument or 1)
            elif name == "ansicpg" and argument:
                page = f"cp{argument.decode()}"
            elif name == "u" and argument:
                pending = 0
                show(chr(int(argument) % 65536))
                pending = skip_after
        elif code:
            try:
                show(bytes([int(code, 16)]).decode(page, "replace"))
            except LookupError:
                show(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol == b"*":
            silent = True
        elif symbol:
            show({b"~": " ", b"_": "‑", b"-": ""}.get(symbol, symbol.decode("latin-1")))
        elif plain:
            show(plain.decode("latin-1"))
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return "\n\n".join(line.rstrip() for line in joined.split("\n") if line.strip())


def markdown_to_plain(text: str) -> str:
    """Markdown without its marks: text and code as they are, cells by tabs, rows by lines, blocks by blank lines."""
    out: list[str] = []
    code = False
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            code = not code
            continue
        if code:
            out.append(line)
            continue
        if re.fullmatch(r"\s*([-*_]\s*){3,}|\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", line) and line.strip():
            continue
        line = re.sub(r"^\s{0,3}(#{1,6}\s+|>\s?)", "", line)
        line = re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", line)
        if line.strip().startswith("|") and line.strip().endswith("|"):
            line = "\t".join(c.strip() for c in line.strip().strip("|").split("|"))
        line = re.sub(r"!?\[([^\]^]*)\]\([^)]*\)", r"\1", line)
        line = re.sub(r"\[\^([^\]]+)\]", r"[\1]", line)
        line = re.sub(r"(\*\*|__)(.+?)\1", r"\2", line)
        line = re.sub(r"(?<![\w*])([*_])(?!\s)(.+?)(?<!\s)\1(?![\w*])", r"\2", line)
        out.append(re.sub(r"`([^`]*)`", r"\1", line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n") + "\n" if any(out) else ""


READERS = {"doc": legacy.doc, "ppt": legacy.ppt, "docx": docx, "pptx": pptx, "odt": open_document, "odp": open_document, "epub": epub, "rtf": rtf}


def convert(data: bytes, fmt: str) -> Outcome:
    if fmt not in READERS:
        raise ConvertError("unclaimed_format", fmt)
    try:
        text = normalize(READERS[fmt](data))
    except struct.error as e:
        raise ConvertError("malformed", str(e)) from None
    text = text + "\n" if text else ""
    if data and not text:
        raise ConvertError("empty_output", f"source is {len(data)} bytes but conversion produced no text")
    warnings = differential.check(text, data, fmt) if fmt in differential.SCANS else []
    return Outcome(text, "anydoc-document", warnings, [Segment("span", 0, len(text.encode()), "document")])
