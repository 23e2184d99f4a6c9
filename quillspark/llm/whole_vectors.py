"""Vectors of numbers as vectors of integers: each component x becomes floor(scale * x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer vectors of this length (in the sense of geometry) or more are too long: distances and products need not fit a long.
LONGEST = 2.0**30


def numbers(vectors: DataFrame, name: str = "embedding") -> Column:
    """The vectors' column as floats or doubles; other numbers are cast to double."""
    return F.col(name) if dict(vectors.dtypes)[name] == "array<float>" else F.col(name).cast("array<double>")


def whole(column: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integers) of the usable vectors of a column, those of one width at a time.

    Unusable are vectors that are null, have a null or non-finite component, or are as long as ``LONGEST``.
    """
    widths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(np.maximum(widths, 0)) - np.maximum(widths, 0)
    for width in np.unique(widths[widths >= 0]).tolist():
        rows = np.flatnonzero(widths == width)
        with np.errstate(all="ignore"):
            values = np.floor(flat[starts[rows][:, None] + np.arange(width)] * scale)
            good = np.isfinite(values).all(axis=1)
            good &= np.sqrt((values * values).sum(axis=1)) < LONGEST
        yield rows[good], values[good].astype(np.int32)


def packed(values: np.ndarray) -> pa.BinaryArray:
    """Each row's integers as one value of four bytes a number, which Spark moves at once."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(4 * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def unpacked(values: list[bytes] | np.ndarray) -> np.ndarray:
    """The rows of :func:`packed`, all of one width, as longs."""
    rows = len(values)
    return np.frombuffer(b"".join(values), np.int32).reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)
