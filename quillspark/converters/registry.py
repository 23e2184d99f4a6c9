"""Converters by id, for all formats that have one."""

from __future__ import annotations

from collections.abc import Callable

from quillspark.converters import archive, document, html, images, mail, media, pdf, records, workbook
from quillspark.converters.base import ConvertError, Outcome, gate, passthrough
from quillspark.plans import formats

Converter = Callable[[bytes, str], Outcome]
CONVERTERS: dict[str, Converter] = {
    "text-passthrough": lambda data, _: passthrough(data),
    "html-strip": lambda data, _: html.convert(data),
    "eml-mime": lambda data, _: mail.convert(data),
    "container-zip": lambda data, _: archive.convert(data),
    "anydoc-document": document.convert,
    "workbook-ir": workbook.convert,
    "pdf-subprocess": pdf.convert,
    "records-worker": records.convert,
    "image-pixel-ocr": images.recognise,
    "asr-adapter": media.convert,
}
_ROUTE = {i: (c, r) for i, _, c, r in formats.all_formats()}


class Registry:
    """Which converter a format goes to; refuses unknown ids, wrong versions and formats claimed twice."""

    def __init__(self, routes: list[tuple[str, str, str]], converters: dict[str, Converter] = CONVERTERS):
        self.routes: dict[str, str] = {}
        self.converters = converters
        for fmt, converter, version in routes:
            if converter not in converters:
                raise formats.RulesError(f"unknown converter {converter}")
            if version != formats.VERSIONS[converter]:
                raise formats.RulesError(f"{converter} is {formats.VERSIONS[converter]}, not {version}")
            if self.routes.setdefault(fmt, converter) != converter:
                raise formats.RulesError(f"{fmt} is claimed twice")


def route(fmt: str) -> tuple[str | None, str | None]:
    """(converter, None) or (None, reason) of a format."""
    converter, reason = _ROUTE.get(fmt, (None, "no-converter"))
    return converter, None if converter else reason or "no-converter"


def convert(data: bytes, fmt: str) -> tuple[Outcome | None, str | None]:
    """(outcome, None) or (None, error); no input stops more than its own record."""
    converter, reason = route(fmt)
    if converter is None:
        return None, reason
    if len(data) > formats.MAX_SOURCE:
        return None, f"resource_limit: source exceeds {formats.MAX_SOURCE} bytes"
    try:
        return gate(CONVERTERS[converter](data, fmt)), None
    except ConvertError as e:
        return None, str(e)
    except (RecursionError, MemoryError, ArithmeticError, LookupError, TypeError, ValueError, OSError) as e:
        return None, f"converter_panic: {type(e).__name__}"
