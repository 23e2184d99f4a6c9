"""A second extraction of legacy Office files, compared with the first."""

from __future__ import annotations

import struct

from quillspark.converters import biff, legacy
from quillspark.converters.base import ConvertError
from quillspark.operators.agreement import judged

SECONDARY = "stream-scan/1"
SCANS = {"doc": legacy.doc_scan, "ppt": legacy.ppt_scan, "xls": biff.xls_scan}


def check(primary: str, data: bytes, fmt: str) -> list[str]:
    """Warnings of a comparison; raises if the first extraction holds less than half of what the second found."""
    try:
        secondary = SCANS[fmt](data)
    except (ConvertError, struct.error, LookupError, ValueError, RecursionError) as e:
        return [f"differential-unavailable: {e.code if isinstance(e, ConvertError) else type(e).__name__}"]
    verdict, ratio, dice = judged(primary, secondary)
    shown = f"secondary={SECONDARY} len_ratio={ratio:.4f} dice={dice:.4f}"
    if verdict == "failure":
        raise ConvertError("differential-divergence", shown)
    return [f"differential-divergence: {shown}"] if verdict == "divergence" else []
