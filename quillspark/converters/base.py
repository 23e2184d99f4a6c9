"""What converters share: outcomes and errors as values, ceilings, and the text gates."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field

from quillspark.plans import formats

#: Format characters that show nothing (fixed values).
INVISIBLE = {0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065)}


class ConvertError(Exception):
    """A source could not be converted; never stops more than its record."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass
class Segment:
    """A marked stretch of a text, in UTF-8 bytes."""

    kind: str
    start: int
    end: int
    source: str
    name: str | None = None
    hidden: bool = False


@dataclass
class Outcome:
    """A converter's result."""

    text: str
    converter_id: str
    warnings: list[str] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    artifact_kind: str = "text"
    members: list[tuple[str, bytes]] = field(default_factory=list)
    media: dict | None = None
    tool_version: str | None = None


def normalize(text: str) -> str:
    """Line ends to LF, then NFC."""
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def decode(data: bytes) -> tuple[str, list[str]]:
    """A text source's characters, by its byte order mark or as strict UTF-8, and warnings."""
    if data[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
        raise ConvertError("unsupported-encoding", "UTF-32")
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data[:2] == mark:
            body = data[2:]
            if len(body) % 2:
                raise ConvertError("invalid_utf16", f"odd byte at {len(data) - 1}")
            try:
                return body.decode(name), [f"transcoded from {name}"]
            except UnicodeDecodeError as e:
                raise ConvertError("invalid_utf16", f"unpaired surrogate at byte {e.start + 2}") from None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConvertError("invalid_utf8", f"invalid UTF-8 at byte {e.start}") from None
    return (text[1:], ["stripped leading byte order mark"]) if text[:1] == "﻿" else (text, [])


def has_meaning(text: str) -> bool:
    return any(not c.isspace() and unicodedata.category(c) != "Cc" and ord(c) not in INVISIBLE for c in text)


def passthrough(data: bytes) -> Outcome:
    text, warnings = decode(data)
    if "\0" in text:
        raise ConvertError("nul_bytes", f"NUL at byte {len(text[: text.index(chr(0))].encode())} of the source text")
    text = normalize(text)
    if data and not text:
        raise ConvertError("empty_output", f"source is {len(data)} bytes but holds no text")
    return Outcome(text, "text-passthrough", warnings, [Segment("span", 0, len(text.encode()), "document")])


def gate(outcome: Outcome) -> Outcome:
    """The outcome if its text is fit to be written."""
    raw = outcome.text.encode()
    if len(raw) > formats.MAX_OUTPUT:
        raise ConvertError("resource_limit", f"text exceeds {formats.MAX_OUTPUT} bytes")
    if b"\0" in raw:
        raise ConvertError("nul_bytes", f"NUL at byte {raw.index(0)} of the converted text")
    problem = segments_problem(outcome.segments, raw)
    if problem:
        raise ConvertError("invalid_segments", problem)
    return outcome


def segments_problem(segments: list[Segment], raw: bytes) -> str | None:
    """The first rule that segments of a text break: order, bounds, character boundaries."""
    before = (-1, -1)
    for s in segments:
        if not 0 <= s.start <= s.end <= len(raw):
            return f"segment {s.start}..{s.end} lies outside {len(raw)} bytes"
        if any(at < len(raw) and raw[at] & 0xC0 == 0x80 for at in (s.start, s.end)):
            return f"segment {s.start}..{s.end} cuts a character"
        if s.kind != "span" and s.start != s.end:
            return f"boundary {s.start}..{s.end} has a width"
        if (s.start, s.end) < before:
            return "segments are out of order"
        before = (s.start, s.end)
    return None


def sidecar(segments: list[Segment]) -> bytes:
    """Segments as JSON lines."""
    lines = []
    for s in segments:
        fields = {"kind": s.kind, "unit": "utf8_bytes", "start": s.start, "end": s.end, "source": s.source, "name": s.name, "hidden": True if s.hidden else None}
        lines.append(json.dumps({k: v for k, v in fields.items() if v is not None}, ensure_ascii=False, separators=(",", ":")) + "\n")
    return "".join(lines).encode()


def sidecar_problem(data: bytes, raw: bytes) -> str | None:
    """What is wrong with a sidecar's bytes beside the text they belong to."""
    segments = []
    try:
        for k, line in enumerate(data.decode("utf-8").splitlines(), 1):
            fields = json.loads(line)
            if not isinstance(fields, dict) or fields.keys() - {"kind", "unit", "start", "end", "source", "name", "hidden"}:
                return f"line {k}: not a segment"
            if fields.get("kind") not in ("span", "page", "sheet", "slide") or fields.get("unit") != "utf8_bytes":
                return f"line {k}: unknown kind or unit"
            if not all(type(fields.get(f)) is int for f in ("start", "end")):
                return f"line {k}: offsets missing"
            segments.append(Segment(fields["kind"], fields["start"], fields["end"], fields.get("source") or "", fields.get("name"), fields.get("hidden") is True))
    except ValueError as e:
        return str(e)
    return segments_problem(segments, raw)
