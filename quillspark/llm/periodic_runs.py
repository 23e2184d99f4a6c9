"""Periodic runs of words by block matching: stretches that repeat with a period, four times over at least.

A run of period q holds, for the power of two L with L <= q < 2L, at least two neighbouring blocks of L words that start at
multiples of L and stand again q words on. So at each scale L the aligned blocks become the keys (sequences of word
numbers) of an Aho-Corasick automaton, the text is searched for all of them at once, and an occurrence at a distance from L
to 2L behind its block is a seed. Seeds of neighbouring blocks at one distance form chains, which are extended word by word in
both directions. A seed inside a run of a smaller scale only shows a multiple of that run's period again.

Automata are built only where a run of their scale can be: where short word groups keep coming back within 2L words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold_crc, unused

#: A word, in Python and for Spark.
WORD, JAVA_WORD = "[^\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
_WORD = re.compile(WORD)
#: A run's words, and its periods, at least.
LEAST, TIMES = 6, 4


def recurrence(words: np.ndarray, width: int) -> np.ndarray:
    """For each group of ``width`` words (a power of two), by its first, how far back the same group stood; a large number if nowhere.

    Groups are told apart by hashes: two that differ may seem equal, two equal ones never seem to differ.
    """
    key = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = 1
        while step < width:
            key = key[: len(key) - step] * np.uint64(0x9E3779B97F4A7C15) + (key[step:] ^ np.uint64(step))
            step *= 2
    far = np.full(len(key), len(words) + 1, np.int64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    far[order[same + 1]] = order[same + 1] - order[same]
    return far


def stretches(true: np.ndarray) -> np.ndarray:
    """(first, end) of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], true.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def seeds(words: np.ndarray, first: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of each aligned block of ``size`` words in words[first:end] and each later occurrence at a distance of size to 2 * size - 1."""
    begin = -(-first // size)
    blocks = (end - begin * size) // size
    if blocks < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    rows = words[begin * size : (begin + blocks) * size].reshape(blocks, size).tolist()
    names = np.empty(blocks, np.int64)
    for k, row in enumerate(rows):
        key = tuple(row)
        names[k] = automaton.get(key, k)
        if names[k] == k:
            automaton.add_word(key, k)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(tuple(words[begin * size : end].tolist()))), np.int64).reshape(-1, 2)
    start = found[:, 0] - size + 1
    block = start // size - 1  # the one aligned block that starts from size to 2 * size - 1 words before
    good = block >= 0
    good[good] &= names[block[good]] == found[good, 1]
    block, start = block[good], start[good]
    return block + begin, start - block * size


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch of at least ``LEAST`` words and ``TIMES`` times its smallest period that no neighbouring word
    extends. words: numbers, equal for equal words.
    """
    n, found = len(words), [np.zeros((0, 3), np.int64)]
    far: dict[int, np.ndarray] = {}
    size = 1
    while TIMES * size <= n and n >= LEAST:
        width = min(size, 4)
        if width not in far:
            far[width] = recurrence(words, width)
        known = np.concatenate(found)
        known = known[np.argsort(known[:, 0], kind="stable")]
        reach = np.maximum.accumulate(known[:, 0] + known[:, 1]) if len(known) else known[:, 0]

        def inside(first: np.ndarray, end: np.ndarray, known: np.ndarray = known, reach: np.ndarray = reach) -> np.ndarray:
            """Whether words[first:end] lies in one run of a smaller scale."""
            at = np.searchsorted(known[:, 0], first, side="right")
            return (at > 0) & (np.append(reach, 0)[at - 1] >= end)

        hot = stretches(far[width] < 2 * size)
        hot = hot[hot[:, 1] - hot[:, 0] >= max(3 * size - width + 1, LEAST - 2 * size - width + 2)]
        hot = hot[~inside(hot[:, 0], hot[:, 1])]  # a run of this scale and one of a smaller share too few words for that
        new = []
        for first, end in merged(hot[:, 0] - 2 * size, hot[:, 1] + width, n):
            new += _extended(words, *seeds(words, first, end, size), size, inside)
        if new:
            found.append(np.unique(np.array(new, np.int64), axis=0))
        size *= 2
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def merged(first: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Rising intervals cut to 0..n, those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(first, 0).tolist(), np.minimum(end, n).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _extended(words: np.ndarray, block: np.ndarray, distance: np.ndarray, size: int, inside: object) -> Iterator[tuple[int, int, int]]:
    """The runs that chains of neighbouring blocks at one distance belong to."""
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    chain = np.flatnonzero(np.append(True, (block[1:] != block[:-1] + 1) | (distance[1:] != distance[:-1])))
    count = np.diff(np.append(chain, len(block)))
    chain, count = chain[count >= 2], count[count >= 2]  # a run holds two neighbouring blocks at least
    first, far = block[chain] * size, distance[chain]
    end = first + count * size + far
    new = ~inside(first, end)
    for a, b, q in zip(first[new].tolist(), end[new].tolist(), far[new].tolist()):
        a -= _agreeing(words[max(0, a - size) : a][::-1], words[max(0, a - size) + q : a + q][::-1])
        b += _agreeing(words[b - q : b - q + size], words[b : b + size])
        if b - a >= max(LEAST, TIMES * q):
            yield a, b - a, q


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many first words agree; a chain ends where the next block disagrees, so there are less than a block's."""
    n = min(len(left), len(right))
    apart = np.flatnonzero(left[:n] != right[:n])
    return int(apart[0]) if len(apart) else n


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: not if some run holds it behind that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, runs (array of start, length, period, by start, then period) and collapsed to each row of ``docs``.

    Words are stretches without ``\\x20`` and ``\\x09-\\x0D``, numbered from 0, whole texts; ``collapsed`` are the words that are in
    no run behind its first period, joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``. ``keep`` names the columns that stay (doc_id unless given), except those named like a result. Null ids
    and repeated rows count like any others; an empty table gives no rows.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("n_words", "runs", "collapsed")]
    text = unused("_text", keep)
    columns = docs.select(*keep, F.col("text").alias(text))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for value in batch[len(keep)]:
                words = _WORD.findall(value.as_py() or "")
                numbers: dict[str, int] = {}
                found = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))
                counts.append(len(words))
                runs.append(found)
                if len(found):
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
                texts.append(" ".join(words))
            every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), listed.cast(kind), pa.array(texts, pa.string())], [*keep, "n_words", "runs", "collapsed"])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in columns.schema[: len(keep)]]
    return columns.mapInArrow(run, ", ".join([*fields, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end planted where crc32 of the id is divisible by 10; a null id's text stays as it is."""
    h = fold_crc(doc_id)
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(JAVA_WORD), F.lit(0))

    def spread(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (place(i) + 1).cast("int")))

    many = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(spread(w), " ")))[0]
    return F.when(h % 10 == 0, F.coalesce(many, text)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent with its exponent in thousandths, and digests of all runs and of the collapsed text.

    Exponents are compared as fractions: length * other period against other length * period.
    """
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])  # noqa: E731  (runs come by start, then period: the first of equals stays)
    top = F.aggregate("runs", F.element_at("runs", 1), lambda a, b: F.when(better(a, b), b).otherwise(a))
    best = F.when(F.size("runs") > 0, top)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return shown.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
