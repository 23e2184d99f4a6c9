"""Engines that are installed by whoever has them, named so that every worker can import them.

    speech       (samples, rate) -> speech segments, or (segments, media, tool version)
    recognition  (bytes, format) -> recognised lines as (text, confidence)
    vector       (bytes, width, height) -> a png of that size
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

NAMES = ("speech", "recognition", "vector")
_engines: dict[str, Callable] = {}


def install(engines: dict[str, str] | None) -> None:
    """Replace all engines by those at ``module:function``; called in each worker."""
    _engines.clear()
    for name, place in (engines or {}).items():
        if name not in NAMES:
            raise ValueError(f"unknown engine {name}")
        module, _, attribute = place.partition(":")
        _engines[name] = getattr(importlib.import_module(module), attribute)


def engine(name: str) -> Callable | None:
    return _engines.get(name)
