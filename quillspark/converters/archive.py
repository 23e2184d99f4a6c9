"""Zip archives: listing, member checks, and recursive expansion inside one task per top-level container."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from quillspark.converters import mail
from quillspark.converters.base import ConvertError, Outcome, Segment
from quillspark.plans import formats


def member_path(raw: str) -> str | None:
    """The safe relative path of a member name, or None."""
    if not raw or any(unicodedata.category(c) == "Cc" for c in raw) or raw[0] in "/\\" or re.match("[A-Za-z]:", raw):
        return None
    parts = re.split(r"[/\\]", raw)
    return None if any(p in ("", ".", "..") for p in parts) else "/".join(parts)


def listed_name(name: str) -> str:
    """A member name on one line."""
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(plain.get(c) or (f"\\x{ord(c):02x}" if unicodedata.category(c) == "Cc" else c) for c in name)


def entry_count(data: bytes) -> int | None:
    """The number of entries that the end record states, read before the directory is; None without such a record."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - 0xFFFF))
    if at < 0 or len(data) < at + 22:
        return None
    count = struct.unpack_from("<H", data, at + 10)[0]
    if count == 0xFFFF and data[at - 20 : at - 16] == b"PK\x06\x07":
        far = struct.unpack_from("<Q", data, at - 12)[0]
        if data[far : far + 4] == b"PK\x06\x06" and len(data) >= far + 40:
            return struct.unpack_from("<Q", data, far + 32)[0]
    return count


@dataclass
class Unit:
    """A member, or the reason why there is none; containers stand after their members."""

    path: str
    parent: str | None
    depth: int
    data: bytes | None = None
    error: str | None = None
    warning: str | None = None


class Expansion:
    """One top-level container's members, depth first, with a budget for the whole."""

    def __init__(self, occupied: Callable[[str], bool] = lambda path: False, hasher: Callable[[bytes], str] = lambda d: hashlib.sha256(d).hexdigest()):
        self.occupied, self.hasher, self.inflated = occupied, hasher, 0

    def run(self, path: str, data: bytes) -> Iterator[Unit]:
        yield from self._container(path, None, data, 0, ())

    def _kind(self, path: str, data: bytes) -> str:
        return formats.TABLE.resolve(path, formats.magic(data))[1]

    def _container(self, path: str, parent: str | None, data: bytes, depth: int, above: tuple[str, ...]) -> Iterator[Unit]:
        digest = self.hasher(data)
        try:
            if depth > formats.MAX_DEPTH:
                raise ConvertError("container-depth-exceeded", f"depth {depth} is over {formats.MAX_DEPTH}")
            if digest in above:
                raise ConvertError("container-recursive", "the archive holds itself")
            if self.occupied(f"{path}.d/"):
                raise ConvertError("container-mirror-collision", f"{path}.d/ is a source's folder")
            members = self._mail(data) if self._kind(path, data) == "eml" else self._zip(data)
            claimed: set[str] = set()
            refused = 0
            for k, (name, content, error) in enumerate(members):
                safe = member_path(name)
                if safe is None:
                    yield Unit(f"{path}.d/#unsafe-member-{k}", path, depth + 1, error="unsafe-member-path")
                    continue
                fold = unicodedata.normalize("NFC", safe).lower()
                if fold in claimed:
                    refused += 1
                    yield Unit(f"{path}.d/#collision-{refused}", path, depth + 1, error=f"member-path-collision: {listed_name(safe)}")
                    continue
                claimed.add(fold)
                child = f"{path}.d/{safe}"
                if error:
                    yield Unit(child, path, depth + 1, error=error)
                elif self._kind(child, content) in formats.CONTAINERS:
                    yield from self._container(child, path, content, depth + 1, (*above, digest))
                else:
                    yield Unit(child, path, depth + 1, data=content)
            yield Unit(path, parent, depth, data=data)
        except ConvertError as e:
            yield Unit(path, parent, depth, error=str(e))

    def _charge(self, size: int) -> None:
        self.inflated += size
        if self.inflated > formats.MAX_EXPANDED:
            raise ConvertError("container-expansion-cap", f"members exceed {formats.MAX_EXPANDED} bytes")

    def _mail(self, data: bytes) -> Iterator[tuple[str, bytes, str | None]]:
        for name, content in mail.convert(data).members:
            self._charge(len(content))
            yield name, content, None

    def _zip(self, data: bytes) -> Iterator[tuple[str, bytes, str | None]]:
        count = entry_count(data)
        if count is not None and count > formats.MAX_CHILDREN:
            raise ConvertError("container-children-exceeded", f"{count} members are over {formats.MAX_CHILDREN}")
        archive = opened(data)
        entries = archive.infolist()
        if len(entries) > formats.MAX_CHILDREN:
            raise ConvertError("container-children-exceeded", f"{len(entries)} members are over {formats.MAX_CHILDREN}")
        if sum(e.file_size for e in entries) > formats.MAX_EXPANDED:
            raise ConvertError("container-expansion-cap", "declared sizes are over the budget")
        for e in entries:
            if e.is_dir():
                continue
            if e.external_attr >> 28 == 0xA:
                yield e.orig_filename, b"", "unsafe-member-path: symlink"
            elif e.flag_bits & 1:
                yield e.orig_filename, b"", "encrypted"
            elif e.file_size > formats.MAX_MEMBER:
                yield e.orig_filename, b"", "container-member-too-large"
            else:
                try:
                    with archive.open(e) as file:
                        content = file.read(formats.MAX_MEMBER + 1)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError) as x:
                    yield e.orig_filename, b"", f"container-member-unreadable: {x}"
                    continue
                self._charge(len(content))
                too_large = "container-member-too-large" if len(content) > formats.MAX_MEMBER else None
                yield e.orig_filename, b"" if too_large else content, too_large


def opened(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError, struct.error) as e:
        raise ConvertError("container-unreadable", f"zip central directory unreadable: {e}") from None


def convert(data: bytes) -> Outcome:
    """The listing: each entry's name and declared size, in archive order."""
    text = "".join(f"{listed_name(e.orig_filename)}\t{e.file_size}\n" for e in opened(data).infolist())
    text = unicodedata.normalize("NFC", text)
    return Outcome(text, "container-zip", [], [Segment("span", 0, len(text.encode()), "document")])
