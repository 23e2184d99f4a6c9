"""The text layer of PDF files: a small reader of content streams, without layout."""

from __future__ import annotations

import re
import zlib

from quillspark.converters.base import ConvertError, Outcome, Segment, has_meaning, normalize
from quillspark.plans import formats

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}


def _inflated(body: bytes, head: bytes, budget: list[int]) -> bytes:
    if b"FlateDecode" in head:
        inflater = zlib.decompressobj()
        try:
            body = inflater.decompress(body, budget[0] + 1)
        except zlib.error:
            return b""
    elif b"/Filter" in head:
        return b""
    budget[0] -= len(body)
    if budget[0] < 0:
        raise ConvertError("resource_limit", f"pdf streams exceed {formats.MAX_OUTPUT} bytes")
    return body


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _shown(raw: bytes, unicode_map: dict[int, str]) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16be", "replace")
    if unicode_map and len(raw) % 2 == 0:
        pairs = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]
        if all(p in unicode_map for p in pairs):
            return "".join(map(unicode_map.__getitem__, pairs))
    return raw.decode("cp1252", "replace")


def _unicode_map(streams: list[bytes]) -> dict[int, str]:
    """Character codes of all ToUnicode maps together."""
    out: dict[int, str] = {}
    for s in streams:
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", s, re.S):
            for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(code, 16)] = bytes.fromhex(text.decode()).decode("utf-16be", "replace")
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", s, re.S):
            for first, last, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", block):
                for k in range(min(int(last, 16) - int(first, 16) + 1, 65536)):
                    out[int(first, 16) + k] = chr(min(int(text, 16) + k, 0xFFFF))
    return out


def text_of(stream: bytes, unicode_map: dict[int, str]) -> str:
    """The strings that a content stream shows, a line for each move of the text position."""
    out: list[str] = []
    held: list[str] = []
    inside = False
    for m in _TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            held.append(_shown(_string(token), unicode_map))
        elif inside and re.fullmatch(rb"-\d{3,}\.?\d*", token):
            held.append(" ")
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out += (["\n"] if token in (b"'", b'"') else []) + held
            held = []
        elif token in (b"Td", b"TD", b"T*", b"ET", b"Tm"):
            out.append("\n")
            held = []
        elif token == b"[":
            inside = True
        elif token == b"]":
            inside = False
        elif token.isalpha():
            held = []
    lines = [re.sub(r" +", " ", line).strip() for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def convert(data: bytes, fmt: str = "pdf") -> Outcome:
    if data[:4] != b"%PDF" and b"%PDF" not in data[:1024]:
        raise ConvertError("malformed", "no pdf header")
    if b"/Encrypt" in data:
        raise ConvertError("encrypted", "the document is encrypted")
    budget = [formats.MAX_OUTPUT]
    streams = []
    for _, _, body in _OBJECT.findall(data):
        m = _STREAM.search(body)
        if m:
            streams.append(_inflated(m[1], body[: m.start()], budget))
    codes = _unicode_map(streams)
    pages = [text_of(s, codes) for s in streams if re.search(rb"\bBT\b", s)]
    pictures = sum(bool(re.search(rb"/\S+\s+Do\b", s)) and not text_of(s, codes) for s in streams)
    shown = [p for p in pages if p]
    text = normalize("\n\n".join(shown))
    if not has_meaning(text):
        raise ConvertError("pdf_no_text_layer", "the document shows no text")
    text += "\n"
    warnings = [f"pdf_partial_text: {pictures} of {pictures + len(shown)} pages show a picture and no text"] if pictures else []
    # a document that is mostly pictures is not trusted as converted: what text it has is recovered, and says so
    recovered = pictures > len(shown)
    return Outcome(text, "pdf-text-recovered" if recovered else "pdf-subprocess", warnings, [Segment("span", 0, len(text.encode()), "document")])
