"""Mail messages to text: headers, chosen bodies, and attachments as members."""

from __future__ import annotations

import email
import email.policy
import re
from email.header import decode_header, make_header
from email.message import Message

from quillspark.converters.base import ConvertError, Outcome, Segment, normalize
from quillspark.converters.html import strip_html
from quillspark.plans import formats

HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Date", "Subject")
#: Ceilings (fixed values).
MAX_PARTS, MAX_HEADERS, MAX_HEADER_BYTES, MAX_NESTING, MAX_BOUNDARIES, MAX_TYPES = 1000, 1000, 1 << 20, 16, 10_000, 1000


def attachment_name(name: str | None) -> str:
    last = re.split(r"[/\\]", name or "")[-1]
    return "".join(c for c in last if ord(c) >= 32 and not 127 <= ord(c) < 160).strip().strip(".") or "unnamed"


def _header(message: Message, name: str) -> str:
    try:
        return normalize(str(make_header(decode_header(message.get(name, "") or "")))).replace("\n", " ").strip()
    except (LookupError, UnicodeDecodeError, ValueError):
        raise ConvertError("mime_decode_error", f"header {name}") from None


class _Walk:
    """Counts what a message holds while it collects bodies and attachments."""

    def __init__(self) -> None:
        self.parts = self.headers = self.header_bytes = self.decoded = 0
        self.bodies: list[str] = []
        self.attachments: list[tuple[str, bytes]] = []

    def count(self, part: Message, depth: int) -> None:
        self.parts += 1
        self.headers += len(part.keys())
        self.header_bytes += sum(len(k) + len(str(v)) for k, v in part.items())
        for what, now, most in (("parts", self.parts, MAX_PARTS), ("headers", self.headers, MAX_HEADERS), ("header bytes", self.header_bytes, MAX_HEADER_BYTES), ("nesting", depth, MAX_NESTING)):
            if now > most:
                raise ConvertError("resource_limit", f"mail {what} exceed {most}")

    def payload(self, part: Message) -> bytes:
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            return inner[0].as_bytes() if isinstance(inner, list) and inner else b""
        data = part.get_payload(decode=True)
        if data is None:
            raise ConvertError("mime_decode_error", "part without content")
        self.decoded += len(data)
        if self.decoded > formats.MAX_SOURCE:
            raise ConvertError("resource_limit", f"decoded mail exceeds {formats.MAX_SOURCE} bytes")
        return data

    def visit(self, part: Message, depth: int, take: bool) -> None:
        self.count(part, depth)
        kind = part.get_content_type()
        if part.get_content_maintype() == "multipart":
            children = [p for p in part.get_payload() if isinstance(p, Message)] if isinstance(part.get_payload(), list) else []
            chosen: Message | None = None
            if kind == "multipart/alternative" and children:
                by_kind = lambda k: next((c for c in children if c.get_content_type() == k), None)
                chosen = by_kind("text/plain") or by_kind("text/html") or children[0]
            for child in children:
                self.visit(child, depth + 1, take and (chosen is None or child is chosen))
            return
        attached = part.get_content_disposition() == "attachment" or kind == "message/rfc822" or part.get_content_maintype() != "text"
        data = self.payload(part)
        if not take:
            return
        if attached:
            self.attachments.append((f"{len(self.attachments) + 1}-{attachment_name(part.get_filename())}", data))
            return
        try:
            text = data.decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            raise ConvertError("mime_decode_error", f"{kind} body") from None
        self.bodies.append(strip_html(text) if kind == "text/html" else text)


def convert(data: bytes) -> Outcome:
    if data.lower().count(b"content-type") > MAX_TYPES or data.count(b"\n--") > MAX_BOUNDARIES:
        raise ConvertError("resource_limit", "too many mail parts")
    if not re.match(rb"[!-9;-~]+:", data):
        raise ConvertError("mime_parse_error", "no header at the start")
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    walk = _Walk()
    walk.visit(message, 0, True)
    head = "".join(f"{name}: {value}\n" for name in HEADERS if (value := _header(message, name)))
    bodies = [normalize(b).strip("\n") + "\n" for b in walk.bodies if b.strip()]
    text = normalize(head + ("\n" if head and bodies else "") + "\n".join(bodies))
    if data and not text:
        raise ConvertError("empty_output", f"source is {len(data)} bytes but holds no text")
    return Outcome(text, "eml-mime", [], [Segment("span", 0, len(text.encode()), "document")], members=walk.attachments)
