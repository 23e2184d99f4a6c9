"""The size that an svg file asks for, from its root element alone; drawing it is a hook that is empty by default."""

from __future__ import annotations

import math
import re
from xml.parsers import expat

from quillspark.converters import hooks, images
from quillspark.converters.base import ConvertError, Outcome

#: Bytes in which the root element must stand (fixed value), and pixels per unit (fixed values).
HEAD = 64 << 10
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}


class _Found(Exception):
    pass


def pixels(length: str | None) -> float | None:
    """A CSS length in px, or None if its unit is unknown or it is not above zero."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z%]*)\s*", length or "")
    if not m or m[2].lower() not in UNITS:
        return None
    value = float(m[1]) * UNITS[m[2].lower()]
    return value if 0 < value < math.inf else None


def geometry(data: bytes) -> tuple[float, float]:
    """Width and height in px: both attributes, else the view box."""
    root: dict[str, str] = {}

    def start(name: str, attributes: dict[str, str]) -> None:
        if name.rpartition(":")[2] != "svg":
            raise ConvertError("rasterizer-malformed", f"the root is {name}")
        root.update(attributes)
        raise _Found

    def refuse(*_: object) -> None:
        raise ConvertError("rasterizer-malformed", "entity declarations are refused")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EntityDeclHandler = start, refuse
    try:
        parser.Parse(data[:HEAD], False)
        raise ConvertError("rasterizer-malformed", f"no root element in {HEAD} bytes")
    except _Found:
        pass
    except expat.ExpatError as e:
        raise ConvertError("rasterizer-malformed", str(e)) from None
    width, height = pixels(root.get("width")), pixels(root.get("height"))
    if width is None or height is None:
        box = [pixels(v.lstrip("-")) for v in re.split(r"[\s,]+", root.get("viewBox", "").strip())]
        width, height = (box[2], box[3]) if len(box) == 4 else (None, None)
    if width is None or height is None:
        raise ConvertError("rasterizer-geometry-unresolved", "neither width and height nor a view box")
    return width, height


def rasterized(data: bytes) -> Outcome | None:
    """The text of a vector image's picture, by the installed engines; None if there is no engine to draw it."""
    draw = hooks.engine("vector")
    if draw is None:
        return None
    width, height = (max(1, math.ceil(x)) for x in geometry(data))
    if width * height > images.MAX_AREA:
        raise ConvertError("image-ocr-area-exceeded", f"{width} x {height} is over {images.MAX_AREA} pixels")
    picture = draw(data, width, height)
    if images.dimensions(picture, "png") != (width, height):
        raise ConvertError("rasterizer-geometry-mismatch", f"the picture is not {width} x {height}")
    return images.recognise(picture, "png")
