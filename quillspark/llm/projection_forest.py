"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits all vectors of a label, then what came into each child, and so on until leaves are small. A node has a few
children and directions of its own, one for each; a vector goes to the child along whose direction it reaches farthest, and
spills into those along which it reaches nearly as far. The places of two unit vectors along independent directions are
normal variables that depend on their cosine alone, so how far to spill, and how many trees, follows from the number of
children, the levels and the recall asked for, whatever the vectors are (see ``plan``). A node's directions come from the
numbers of its tree and node alone: nothing is fitted or broadcast, and every vector finds its leaves by itself. Inside a leaf
all pairs are compared in double precision, large leaves in blocks; a pair that meets in several leaves counts in the first
alone. Leaves are compared in passes that move about as many rows as there are vectors, however many leaves a vector has;
what a pass shuffled is deleted before the next. Vectors that are equal are one from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.chosen_path import in_blocks
from quillspark.llm.common import Scratch, apart, mix64, shuffles_deleted
from quillspark.llm.components import components, local_roots
from quillspark.llm.grouped import runs_of_groups

#: Vectors in a leaf aimed at, and in a block of a leaf that is larger all the same.
LEAF, BLOCK = 512, 2048
#: Leaf rows that a pass moves at least.
PASS = 500_000
#: Labels of which the size is told to the executors, the largest; the others are split as the largest of them is.
SIZED = 10_000
#: Blocked leaves whose numbers of blocks are broadcast, at most.
BLOCKED = 50_000
#: Children a node may have; levels that a tree has at least and at most; trees of a forest, at least.
CHILDREN, LEVELS, TREES = (2, 4, 8, 16), (2, 24), 8
#: Pairs that a plan is reckoned from.
TRIALS = 4000
#: More than the error of a cosine in single precision.
ROUNDING = 1e-3


@lru_cache(maxsize=64)
def _splits(threshold: float, children: int) -> list[tuple[float, float, float]]:
    """(margin, chance that a pair at the threshold shares no child, children of a vector) for margins, by simulation.

    The chance is an upper bound, three deviations above what was seen.
    """
    rng = np.random.default_rng([7919, children])
    kept, apart = [], []
    for _ in range(TRIALS // 500):
        a, other = rng.standard_normal((2, 500, children), np.float32)
        b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * other
        below_a, below_b = a.max(axis=1, keepdims=True) - a, b.max(axis=1, keepdims=True) - b
        apart.append(np.maximum(below_a, below_b).min(axis=1))
        kept.append(below_a)
    needed, below = np.concatenate(apart), np.concatenate(kept)
    out = []
    for margin in np.arange(0.0, 3.01, 0.05):
        lost = float((needed > margin).mean())
        lost = min(1.0, lost + 3 * math.sqrt(lost * (1 - lost) / len(needed)) + 3 / len(needed))
        out.append((float(margin), lost, float((below <= margin).sum(axis=1).mean())))
    return out


@lru_cache(maxsize=256)
def plan(threshold: float, rows: int, recall: float, leaf: int) -> tuple[int, int, int, float]:
    """Trees, levels, children of a node and margin for a label of ``rows`` vectors and a ``recall`` at the threshold.

    Of the forests of ``TREES`` trees or more with that recall, the one with the least to do: projections, leaf rows to move
    (each as dear as eight times ``leaf`` comparisons, and moved once for each block of its leaf) and comparisons.
    """
    best = (math.inf, TREES, LEVELS[0], CHILDREN[0], 3.0)
    for children in CHILDREN:
        for margin, lost, into in _splits(threshold, children):
            for levels in range(LEVELS[0], LEVELS[1] + 1):
                miss = 1 - (1 - lost) ** levels
                if children**levels > 16 * max(rows, children) or miss >= 1:
                    continue
                trees = max(TREES, math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1)
                inside, each = rows * (into / children) ** levels, into**levels
                projections = children * sum(into**level for level in range(levels))
                cost = trees * (projections + each * (8 * leaf * max(1.0, inside / BLOCK) + inside))
                best = min(best, (cost, trees, levels, children, margin))
    return best[1:]


def leaf_rows(threshold: float, children: int, levels: int, trees: int, margin: float) -> float:
    """Leaves that a vector is in by the plan, on average."""
    return trees * next(into for m, _, into in _splits(threshold, children) if m == margin) ** levels


@lru_cache(maxsize=1024)
def _directions(width: int, children: int, tree: int, level: int) -> np.ndarray:
    return np.random.default_rng([width, children, tree, level]).standard_normal((children, width), np.float32)


def node_signs(tree: int, level: int, node: np.ndarray, width: int) -> np.ndarray:
    """A row of signs for each node, from its numbers alone.

    A level's directions with the signs of a node are that node's own: for any vector they are normal variables as before, and
    the directions of two nodes are as good as independent, since half of the signs differ.
    """
    with np.errstate(over="ignore"):
        key = mix64(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree << 8) + level + 1))
        words = [mix64(key + np.uint64(w) * np.uint64(0xD6E8FEB86659FD93)) for w in range(-(-width // 64))]
    bits = np.unpackbits(np.stack(words, axis=1).view(np.uint8), axis=1)[:, :width]
    return np.float32(1) - np.float32(2) * bits


def leaves(unit: np.ndarray, trees: int, levels: int, children: int, margin: float, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each vector in each leaf it belongs to; leaves of different trees differ."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(unit), chunk):
        part = unit[start : start + chunk].astype(np.float32)
        for tree in range(trees):
            row, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            for level in range(levels):
                turned = part[row] * node_signs(tree, level, node, part.shape[1])
                place = turned @ _directions(part.shape[1], children, tree, level).T
                at, child = np.divmod(np.flatnonzero(place >= place.max(axis=1, keepdims=True) - np.float32(margin)), children)
                row, node = row[at], node[at] * children + child
            rows.append(row + start)
            found.append(node + tree * children**levels)
    return np.concatenate(rows), np.concatenate(found)


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def as_bytes(values: np.ndarray) -> pa.BinaryArray:
    """Each row's numbers as one value: Spark moves that at once, an array number by number."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.itemsize * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def from_bytes(column: pa.BinaryArray, kind: np.dtype) -> np.ndarray:
    """The rows of :func:`as_bytes`; all are of one length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, (int(ends[-1]) - int(ends[0])) // size, int(ends[0])).reshape(len(column), -1)


def met_before(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a value of their lists."""
    sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    width = int(sizes.max()) if len(sizes) else 0
    met = np.zeros(len(left), bool)
    if not width:
        return met
    full = np.full((len(lists), width), -1, np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    full[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    chunk = max(1, 4_000_000 // (width * width))
    for k in range(0, len(left), chunk):
        a, b = full[left[k : k + chunk], :, None], full[right[k : k + chunk], None, :]
        met[k : k + chunk] = ((a == b) & (a >= 0)).any(axis=(1, 2))
    return met


def near_pairs(unit: np.ndarray, side: np.ndarray, threshold: float, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of ``threshold`` or more: between the sides 0 and 1, or among those of side 2."""
    flat = unit.astype(np.float32)
    whole = side[0] == 2
    mine, other = (np.arange(len(side)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(mine), chunk):
        a, b = mine[k : k + chunk], other[k:] if whole else other
        left, right = np.divmod(np.flatnonzero(flat[a] @ flat[b].T >= threshold - ROUNDING), max(1, len(b)))  # few; settled below in doubles
        if whole:
            left, right = left[left < right], right[left < right]
        left, right = a[left], b[right]
        for j in range(0, len(left), 50_000):
            l, r = left[j : j + 50_000], right[j : j + 50_000]
            close = (unit[l] * unit[r]).sum(axis=1) >= threshold
            lefts.append(l[close])
            rights.append(r[close])
    return np.concatenate(lefts), np.concatenate(rights)


def _comparable() -> Column:
    """Whether a row may link: with id and label, and a finite vector that isn't zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    may = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(may, F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9999, leaf: int = LEAF) -> DataFrame:
    """For each row: vec_id, n_links, component_id, kept.

    Two rows are linked if they have the same label, the same length and a cosine of ``threshold`` or more in double
    precision; n_links counts the other rows linked directly, component_id is the smallest id that links lead to, kept
    says that it is the row's own. Rows with a null label, or a vector that is null, empty, zero or has a null or
    non-finite part, link with nothing, nor do rows with a null id, whose component is null and which aren't kept. Rows
    that share an id are vectors of their own. A pair at the threshold is found with a probability of ``recall`` or more,
    closer ones with more, at every size of a label; no pair below it is linked. An empty table gives no rows; further
    columns are ignored. Every label, small or large, gets trees of two levels or more.
    """
    with shuffles_deleted(vectors.sparkSession):
        return _near_vectors(vectors, threshold, recall, leaf)


def _near_vectors(vectors: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    keep = Scratch(vectors.sparkSession)
    part = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # compared as doubles, moved as they are
    number = np.dtype(np.float32 if part == "float" else np.float64)
    columns = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{part}>"))
    marks = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in (1, 2)]
    rows = columns.where(_comparable()).select("*", *marks)
    kinds = rows.groupBy(F.xxhash64("label").alias("label"), F.size("embedding").alias("width")).agg(F.approx_count_distinct("h1").alias("n"))
    largest = kinds.orderBy(F.desc("n"), "label", "width").limit(SIZED + 1).collect()
    size = {(r.label, r.width): 1 << max(0, r.n - 1).bit_length() for r in largest}
    rest = min(size.values(), default=1)
    plans = {n: plan(threshold, n, recall, leaf) for n in set(size.values()) | {rest}}
    kind = "int" if max(trees * children**levels for trees, levels, children, _ in plans.values()) < 1 << 31 else "long"
    names = ["id", "h1", "h2", "vec_id", "copies", "label", "width", "vector", "cells", "ends"]
    per_row = {n: leaf_rows(threshold, children, levels, trees, margin) for n, (trees, levels, children, margin) in plans.items()}
    vectors_in_all = kinds.agg(F.sum("n")).first()[0] or 0
    to_move = sum(r.n * per_row[size[r.label, r.width]] for r in largest) + max(0, vectors_in_all - sum(r.n for r in largest)) * per_row[rest]
    passes = max(1, math.ceil(to_move / max(PASS, vectors_in_all)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, widths = batch[5].to_numpy(), batch[6].to_numpy()
            wanted = np.array([size.get((a, b), rest) for a, b in zip(labels.tolist(), widths.tolist())], np.int64)
            for width, n in sorted(set(zip(widths.tolist(), wanted.tolist()))):
                at = np.flatnonzero((widths == width) & (wanted == n))
                chosen = batch.take(pa.array(at))
                values = np.asarray(chosen[7].flatten(), number).reshape(-1, width)
                row, cell = leaves(unit_rows(values), *plans[n])
                with np.errstate(over="ignore"):
                    turn = mix64(labels[at][row].astype(np.uint64) + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(passes)
                order = np.lexsort((cell, turn, row))  # leaves by pass, then by number: the same order for all vectors of a label
                row, cell, turn = row[order], cell[order], turn[order].astype(np.int64)
                stops = np.searchsorted(row * passes + turn, np.arange(len(chosen) * passes), side="right").reshape(len(chosen), passes)
                begin = pa.array(np.searchsorted(row, np.arange(len(chosen) + 1)), pa.int32())
                cells = pa.ListArray.from_arrays(begin, pa.array(cell, pa.int32() if kind == "int" else pa.int64()))
                own = stops - np.asarray(begin)[:-1, None]
                ends = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * np.int32(passes)), pa.array(own.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*chosen.columns[:7], as_bytes(values), cells, ends], names)

    first = F.first(F.struct("label", "embedding")).alias("v")
    grouped = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), first)
    distinct = grouped.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "vec_id", "copies", F.xxhash64("v.label").alias("label"), F.size("v.embedding").alias("width"), "v.embedding")
    schema = f"id long, h1 long, h2 long, vec_id long, copies long, label long, width int, vector binary, cells array<{kind}>, ends array<int>"
    placed = keep.stored(distinct.mapInArrow(lead, schema), "leaves")

    key = F.xxhash64("label", "width", "cell").alias("key")
    blocks = F.ceil(F.col("count") / BLOCK)
    counts = placed.select("label", "width", F.explode("cells").alias("cell")).select(key).groupBy("key").count()
    more = keep.stored(counts.where(F.col("count") > BLOCK).select("key", "count", blocks.alias("blocks")), "large-leaves")
    moved, large = more.agg(F.sum(F.col("count") * F.col("blocks")), F.count(F.lit(1))).first()
    turns = math.ceil((moved or 0) / max(PASS, vectors_in_all))  # further passes over the large leaves, by pairs of their blocks
    few = F.broadcast(more.select("key", "blocks")) if large <= BLOCKED else more.select("key", "blocks")

    def each(cells: Column, before: Column) -> DataFrame:
        """A row for each of some leaves of each vector, with the leaves before it; ``before``: how many stand before these."""
        told = placed.select("id", "copies", "vector", "cells", "label", "width", before.alias("before"), F.posexplode(cells).alias("pos", "cell"))
        return told.select("id", "copies", "vector", F.slice("cells", F.lit(1), F.col("before") + F.col("pos")).alias("below"), key)

    def dealt(k: int) -> DataFrame:
        """Leaf rows of pass ``k``: unit, side, id, copies, vector, below. The leaves in blocks come after all others."""
        if k >= passes:
            units = in_blocks(each(F.col("cells"), F.lit(0)).join(few, "key"), "blocks")
            return units.where(F.pmod(F.xxhash64(F.lit(5), "unit"), F.lit(turns)) == k - passes)
        before = F.lit(0) if k == 0 else F.element_at("ends", k)
        mine = each(F.slice("cells", before + 1, F.element_at("ends", k + 1) - before), before)
        return (mine.join(few, "key", "left_anti") if large else mine).withColumnRenamed("key", "unit").withColumn("side", F.lit(2))

    def compare(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, side, copies = (rows.column(c).to_numpy() for c in ("id", "side", "copies"))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(ids))):
            if b - a < 2:
                continue
            group = rows.slice(a, b - a).combine_chunks()
            left, right = near_pairs(unit_rows(from_bytes(group.column("vector").chunk(0), number)), side[a:b], threshold)
            new = ~met_before(group.column("below").chunk(0), left, right)
            left, right = left[new], right[new]
            if not len(left):
                continue
            links = np.zeros(b - a, np.int64)
            np.add.at(links, left, copies[a:b][right])
            np.add.at(links, right, copies[a:b][left])
            root = local_roots(b - a, left, right)
            has = np.unique(np.concatenate([left, right]))
            out.append(np.stack([ids[a:b][has], ids[a:b][root[has]], links[has]]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["id", "root", "links"])

    path = keep.path("vector-links")
    for k in range(passes + turns):
        rows_of = dealt(k).select("unit", "side", "id", "copies", "vector", "below")
        runs_of_groups(rows_of, "unit", 1_000, compare, "id long, root long, links long").write.mode("append").parquet(path)
    found = vectors.sparkSession.read.schema("id long, root long, links long").parquet(path)
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), keep)
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = placed.select("id", "h1", "h2", "vec_id", "copies").join(classes, "id", "left").join(counted, "id", "left")
    known = known.select("h1", "h2", "vec_id", "copies", "links", F.coalesce("component", "id").alias("component"))
    smallest = known.groupBy("component").agg(F.min("vec_id").alias("component_id")).select(apart(F.col("component")).alias("component"), "component_id")
    named = known.join(smallest, "component").drop("vec_id")
    able = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = columns.where(~_comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = able.unionByName(alone)
    return keep.result(both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-vectors")
