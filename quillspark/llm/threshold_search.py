"""Exact top-k inner products by a three-phase uniform threshold over slices of the vectors.

The components are cut into slices, and each slice is a node with a list of its own: a table of all rows' parts, read
without the others. A row's score for a query is the sum of its scores in the nodes. First the best entries of each node's
list are gathered and their whole scores found: the k-th best is a cutoff that no result lies below. Then the cutoff is
broadcast, and each node sends every entry that reaches an even share of it: a row that reaches the share in no node can't
reach the cutoff. What has been seen in all nodes raises the cutoff; rows that may still pass it have their missing scores
looked up, and the best whole scores are the result.

Queries are distinct vectors and go in blocks of bounded size, each broadcast and held against all rows. Of rows with the
same vector only the k + 1 with the smallest ids can be in any result, so the others are not in the lists. Each step that
ranks rows within a query is cut to the best before its shuffle, so a query with many ties fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, apart, shuffles_deleted
from quillspark.llm.whole_vectors import numbers, packed, whole

#: Queries of a block, at most, and the bytes that their vectors take, at most (but for a single query wider than that).
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Entries of a node's list gathered first for each query, as a multiple of k.
DEEP = 4
#: Scores that a task holds at once, about.
CELLS = 4_000_000


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, width, vector): usable vectors as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in whole(batch[1], scale):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), pa.array(np.full(len(rows), values.shape[1], np.int32)), packed(values)], ["vec_id", "width", "vector"])

    known = vectors.select(F.col("vec_id").cast("long"), numbers(vectors)).where("vec_id is not null")
    return known.mapInArrow(run, "vec_id long, width int, vector binary")


class Block:
    """The parts of a block's queries in one slice, as one matrix, narrower ones filled with noughts; their names in order."""

    def __init__(self, names: list[int], parts: list[bytes]):
        width = max((len(p) for p in parts), default=0) // 4
        self.names = np.array(names, np.int64)
        self.parts = np.zeros((len(parts), width), np.int64)
        for k, p in enumerate(parts):
            self.parts[k, : len(p) // 4] = np.frombuffer(p, np.int32)
        self.longest = float(np.sqrt((self.parts.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
        self.forms: dict[str, np.ndarray] = {}

    def scores(self, rows: np.ndarray, picked: np.ndarray | None = None) -> np.ndarray:
        """Inner products with each query (queries x rows), or of row k with query ``picked[k]``; missing components are nought.

        Floating point serves where every partial sum is exact in it.
        """
        width = min(rows.shape[1], self.parts.shape[1])
        bound = self.longest * float(np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max(initial=0.0))
        kind = "float32" if bound < 2**23 else "float64" if bound < 2**52 else "int64"
        if kind not in self.forms:
            self.forms[kind] = self.parts.astype(kind)
        mine, other = self.forms[kind][:, :width], rows[:, :width].astype(kind)
        if picked is not None:
            return np.einsum("ij,ij->i", mine[picked], other).astype(np.int64)
        return mine @ other.T


def by_width(parts: pa.BinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of packed vectors of each width."""
    held = parts.to_pylist()
    sizes = np.array([len(p) for p in held])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(held[k] for k in at), np.int32).reshape(len(at), size // 4)


def best(scores: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Places (queries x depth) of the greatest scores of each line; of equal ones, of the smallest ids (which rise along the line)."""
    if scores.shape[1] <= depth:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    least = np.partition(scores, -depth, axis=1)[:, -depth, None]
    above = scores > least
    level = scores == least
    level &= np.cumsum(level, axis=1, dtype=np.int32) <= depth - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(scores), depth)


_ENTRIES = "query long, row long, vec_id long, slice int, score long"


def _gather(lists: DataFrame, blocks: list, depth: int) -> DataFrame:
    """Each task's ``depth`` best entries of its part of a node's list, for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by slice: scores, rows, ids of each query
        for batch in batches:
            slices = batch[0].to_numpy()
            for s in np.unique(slices).tolist():
                mine = batch.filter(pa.array(slices == s))
                block = blocks[s].value
                for at, parts in by_width(mine[3]):
                    order = np.argsort(mine[2].to_numpy()[at], kind="stable")
                    at, parts = at[order], parts[order]
                    step = max(depth, CELLS // max(1, len(block.names)))
                    for k in range(0, len(at), step):
                        rows, ids = (mine[c].to_numpy()[at[k : k + step]] for c in (1, 2))
                        new = block.scores(parts[k : k + step])
                        place = best(new, ids, depth)
                        found = (np.take_along_axis(new, place, 1).astype(np.int64), rows[place], ids[place])
                        if s in held:
                            found = tuple(np.concatenate([a, b], axis=1) for a, b in zip(held[s], found))
                            order = np.lexsort((found[2], -found[0]), axis=1)[:, :depth]
                            found = tuple(np.take_along_axis(x, order, 1) for x in found)
                        held[s] = found
        for s, (scores, rows, ids) in held.items():
            names = np.repeat(blocks[s].value.names, scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, rows.ravel(), ids.ravel(), np.full(len(names), s, np.int32), scores.ravel())], ["query", "row", "vec_id", "slice", "score"])

    return lists.select("slice", "row", "vec_id", "part").mapInArrow(run, _ENTRIES)


def _reaching(lists: DataFrame, blocks: list, cutoff: object, slices: int) -> DataFrame:
    """Every entry of every node's list that reaches an even share of its query's cutoff.

    cutoff: (scores, ids) in the order of the block's queries. A row with a greater id than the cutoff's must be better than the cutoff.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slice_of = batch[0].to_numpy()
            for s in np.unique(slice_of).tolist():
                mine = batch.filter(pa.array(slice_of == s))
                block = blocks[s].value
                scores, ids = cutoff.value
                even, above = -(-scores // slices), scores // slices + 1  # ceil(c / m), and the least n with m * n > c
                for at, parts in by_width(mine[3]):
                    step = max(1, CELLS // max(1, len(block.names)))
                    for k in range(0, len(at), step):
                        rows, own = (mine[c].to_numpy()[at[k : k + step]] for c in (1, 2))
                        new = block.scores(parts[k : k + step])
                        query, row = np.nonzero(new >= even[:, None].astype(new.dtype))
                        value = new[query, row].astype(np.int64)
                        enough = np.where(own[row] > ids[query], value >= above[query], value >= even[query])
                        query, row, value = query[enough], row[enough], value[enough]
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.names[query], rows[row], own[row], np.full(len(row), s, np.int32), value)], ["query", "row", "vec_id", "slice", "score"])

    return lists.select("slice", "row", "vec_id", "part").mapInArrow(run, _ENTRIES)


def _looked_up(pairs: DataFrame, lists: DataFrame, blocks: list) -> DataFrame:
    """The scores (query, row, vec_id, slice, score) of given (query, row, slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = batch[3].to_numpy()
            for s in np.unique(slices).tolist():
                mine = batch.filter(pa.array(slices == s))
                block = blocks[s].value
                order = np.argsort(block.names)
                for at, parts in by_width(mine[4]):
                    names = mine[0].to_numpy()[at]
                    value = block.scores(parts, order[np.searchsorted(block.names, names, sorter=order)])
                    yield pa.RecordBatch.from_arrays([*(mine[c].take(pa.array(at)) for c in range(4)), pa.array(value)], ["query", "row", "vec_id", "slice", "score"])

    met = pairs.join(lists, ["slice", "row"])
    return met.select("query", "row", "vec_id", "slice", "part").mapInArrow(run, _ENTRIES)


def _first(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` best rows of each key: by score, then id, then row. Spark cuts each task's share to ``n`` before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def top_scores(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, slices: int = 2) -> DataFrame:
    """For each query its ``k`` highest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows, a row of the same id or
    vector too. A score is the inner product of the vectors, each component x as floor(``scale`` * x); of vectors of
    different widths the shorter one counts as filled with noughts. Equal scores go by the smaller id; rows that share id
    and score may stand for each other. A query with fewer than ``k`` candidates gets them all. No part take rows with a null id,
    vectors that are null or have a null or non-finite component, and vectors whose integers have a length of 2**30 or more,
    as their products need not fit a long. An empty vector scores 0 with all. A repeated query row gets rows of its own.
    An empty table, or one without queries, gives no rows; further columns are ignored. Nothing is sampled: the result is exact for every data.
    """
    with shuffles_deleted(vectors.sparkSession):
        return _top_scores(vectors, k, every, scale, max(1, slices))


def _top_scores(vectors: DataFrame, k: int, every: int, scale: int, slices: int) -> DataFrame:
    spark, keep = vectors.sparkSession, Scratch(vectors.sparkSession)
    marks = [F.xxhash64(F.lit(n), "vector").alias(f"h{n}") for n in (1, 2)]
    rows = keep.stored(_integers(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "width", *marks, "vector"), "rows")
    wide = rows.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not wide:
        return keep.result(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), "top-scores")
    cut = 4 * -(-wide[0].width // slices)  # bytes of a slice; the last one takes what is over
    part = lambda s: F.substring("vector", F.lit(s * cut + 1), F.lit(cut) if s < slices - 1 else F.octet_length("vector"))
    same = Window.partitionBy("h1", "h2").orderBy("vec_id", "row")
    able = rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1)  # k + 1: one of them may be the query's own
    able = able.select("row", "vec_id", F.explode(F.array(*(F.struct(F.lit(s).alias("slice"), part(s).alias("part")) for s in range(slices)))).alias("e"))
    lists = keep.path("lists")
    able.select("row", "vec_id", "e.*").write.partitionBy("slice").parquet(lists)
    lists = spark.read.schema("row long, vec_id long, part binary, slice int").parquet(lists)

    asked = keep.stored(rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("row", "vec_id", "h1", "h2", "width", "vector"), "queries")
    single = asked.groupBy("h1", "h2").agg(F.min("row").alias("query"), F.first("width").alias("width"), F.first("vector").alias("vector"))
    single = keep.stored(single, "distinct-queries")
    count, widest = single.agg(F.count(F.lit(1)), F.max("width")).first()
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, widest or 0))))
    blocks = max(1, -(-count // max(1, most // 2)))
    block_of = lambda n: F.pmod(F.xxhash64(F.lit(11), "query"), F.lit(n))
    while count and single.groupBy(block_of(blocks)).count().agg(F.max("count")).first()[0] > most:
        blocks *= 2

    deep, tasks = DEEP * (k + 1), max(1, lists.rdd.getNumPartitions())
    depth = min(deep, max(3, -(-8 * deep // tasks)))
    answers = keep.path("answers")
    for b in range(blocks if count else 0):
        _search_block(single.where(block_of(blocks) == b), lists, k, slices, cut, depth, deep).write.mode("append").parquet(answers)
    if not count:
        return keep.result(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), "top-scores")
    found = spark.read.schema("query long, row long, vec_id long, score long").parquet(answers)
    listed = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "row"))).alias("list"))  # k + 1 at most
    named = listed.join(single.select("query", "h1", "h2"), "query").select(apart(F.col("h1")).alias("h1"), "h2", "list")
    mine = asked.select("row", F.col("vec_id").alias("query_id"), "h1", "h2").join(named, ["h1", "h2"])
    others = F.slice(F.filter("list", lambda e: e["row"] != F.col("row")), 1, k)
    each = mine.select("query_id", F.posexplode(others).alias("at", "e"))
    return keep.result(each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.less")).alias("score")), "top-scores")


def _search_block(queries: DataFrame, lists: DataFrame, k: int, slices: int, cut: int, depth: int, deep: int) -> DataFrame:
    """(query, row, vec_id, score): the k + 1 best rows of each query of a block."""
    spark, keep = lists.sparkSession, Scratch(lists.sparkSession)
    held = queries.select("query", "vector").collect()  # one block, of bounded size
    names = [r["query"] for r in held]
    ends = [(s * cut, (s + 1) * cut if s < slices - 1 else None) for s in range(slices)]
    blocks = [spark.sparkContext.broadcast(Block(names, [bytes(r.vector)[a:b] for r in held])) for a, b in ends]

    # first: the nodes' best entries, and their whole scores
    gathered = _first(_gather(lists, blocks, depth), deep, "query", "slice").select("query", "row").distinct()
    every = F.explode(F.array(*(F.lit(s) for s in range(slices)))).alias("slice")
    gathered = keep.stored(gathered.select("query", "row", every), "gathered")
    total = _looked_up(F.broadcast(gathered), lists, blocks).groupBy("query", "row").agg(F.first("vec_id").alias("vec_id"), F.sum("score").alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    last = total.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") == k + 1)
    known = {r["query"]: (r.score, r.vec_id) for r in last.select("query", "score", "vec_id").collect()}
    none = (-(1 << 62), (1 << 63) - 1)  # fewer rows than asked for: all of them are sent
    limits = np.array([known.get(n, none) for n in names], np.int64).reshape(-1, 2)
    cutoff = spark.sparkContext.broadcast((limits[:, 0], limits[:, 1]))

    # second: what reaches an even share of the cutoff anywhere
    seen = _reaching(lists, blocks, cutoff, slices).groupBy("query", "row").agg(
        F.first("vec_id").alias("vec_id"), F.sum("score").alias("score"), F.array_sort(F.collect_list("slice")).alias("slices")
    )
    seen = keep.stored(seen, "seen")
    full = F.size("slices") == slices
    settled = seen.where(full).select("query", "row", "vec_id", "score")
    raised = settled.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") == k + 1).select("query", F.col("score").alias("better"))
    cuts = spark.createDataFrame([(n, int(c)) for n, c in zip(names, limits[:, 0])], "query long, cutoff long")

    # third: the missing scores of rows that may still reach what is known by now; in a node that didn't send it, a row has no more than the share
    share = F.expr(f"(cutoff - pmod(cutoff, {slices})) div {slices}")
    most = F.col("score") + (slices - F.size("slices")) * share
    left = seen.where(~full).join(F.broadcast(cuts.join(raised, "query", "left")), "query").where(most >= F.greatest("cutoff", F.coalesce("better", "cutoff")))
    missing = F.explode(F.array_except(F.array(*(F.lit(s) for s in range(slices))), F.col("slices"))).alias("slice")
    rest = _looked_up(left.select("query", "row", missing), lists, blocks).select("query", "row", "vec_id", "score")
    resolved = left.select("query", "row", "vec_id", "score").unionByName(rest).groupBy("query", "row").agg(F.first("vec_id").alias("vec_id"), F.sum("score").alias("score"))
    answer = keep.result(_first(settled.unionByName(resolved), k + 1, "query"), "block")
    for shared in (*blocks, cutoff):
        shared.unpersist()
    return answer
