"""Groups that stand in a row in sorted partitions, handed on whole without a call per small group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs_of_groups(df: DataFrame, key: str, most_rows: int, fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn(rows, starts)`` to whole groups of equal ``key`` (a long), several at a time.

    Groups are dealt out by key and sorted; ``fn`` gets rows of one or more whole groups and where each starts, as
    soon as there are ``most_rows`` of them. A group must be small enough to be held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column(key).to_numpy()
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            end = len(keys) if last else int(starts[-1])
            rest = rows.slice(end)
            held, count = rest.to_batches(), len(rest)
            if end:
                out = fn(rows.slice(0, end), starts if last else starts[:-1])
                if out is not None and len(out):
                    yield out

        limit = most_rows
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
                if count >= limit:
                    yield from emit(False)
                    limit = max(most_rows, 2 * count)
        if held:
            yield from emit(True)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def pairs_within(starts: np.ndarray, end: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of rows inside each group, about ``chunk`` at a time."""
    sizes = np.diff(np.append(starts, end))
    follows = np.repeat(np.cumsum(sizes), sizes) - np.arange(end) - 1  # rows after each row in its group
    begin = 0
    while begin < end:
        total = np.cumsum(follows[begin:])
        stop = begin + max(1, int(np.searchsorted(total, chunk, side="right")))
        part = follows[begin:stop]
        left = np.repeat(np.arange(begin, stop), part)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
        yield left, right
        begin = stop
