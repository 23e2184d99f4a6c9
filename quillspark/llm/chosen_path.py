"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles; texts with equal sets are one class from the start. A set is embedded as the vector of
its minima under a number of hash functions, so that two sets agree in a position with the probability of their
Jaccard similarity. A run splits all sets by the values in a few sampled positions; sets that stand in a large bucket
are split again by positions sampled for that bucket, and so on; small buckets are compared by brute force. After a few
levels splitting goes on only while all large buckets together need more comparisons than a number for each set and run,
and while it helps. Buckets that stay large, as near copies make them, are compared in blocks, each pair of blocks by
itself. Runs are repeated until a pair at the threshold is found with the target probability at the depth that was
reached.

What the buckets join are candidates by the estimate, with a margin. The groups they form are then compared in whole
sets, again in blocks where they are large, which gives exact links and classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, Sieve, apart, mix64, shingles
from quillspark.llm.components import components, local_roots
from quillspark.llm.grouped import pairs_within, runs_of_groups

#: Hash functions of the embedding.
POSITIONS = 64
#: Sets in a bucket that is compared at once; levels that are always split; sets and shingles in a block of a large bucket.
BUCKET, LEVELS, BLOCK, BLOCK_SHINGLES = 128, 3, 512, 2_000_000
#: Below these levels, comparisons for each set and run that need no further split, and the share of the work of the level
#: above at which a split still helps.
PAIRS, HELPS = 1024, 0.75
_A = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix64(_A + np.uint64(7))


def embed(hashes: np.ndarray) -> np.ndarray:
    """The minima of a set under each hash function."""
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            part = hashes[k : k + 2048, None] * _A + _B
            np.minimum(out, (part >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def chosen(node: np.ndarray, similarity: float) -> np.ndarray:
    """For each node, the positions it splits on, as a mask: 1 / similarity of them on the average, at least one."""
    with np.errstate(over="ignore"):
        draw = mix64(node[:, None] ^ _B)
    mask = draw < np.uint64(int(2**64 / (similarity * POSITIONS)))
    mask[np.arange(len(node)), draw.argmin(axis=1)] = True
    return mask


def agreements(similarity: float) -> np.ndarray:
    """The chance that two sets of this similarity agree in 0, 1, ... positions."""
    k = np.arange(POSITIONS + 1)
    ways = np.array([math.comb(POSITIONS, int(i)) for i in k], float)
    return ways * similarity**k * (1 - similarity) ** (POSITIONS - k)


def least_agreeing(similarity: float, recall: float) -> int:
    """Positions in which two sets must agree to be candidates; a pair at ``similarity`` has fewer with a quarter of the allowed loss at most."""
    return int(np.searchsorted(np.cumsum(agreements(similarity)), (1 - recall) / 4))


def missed(similarity: float, levels: int) -> np.ndarray:
    """The chance that a run's splits part two sets that agree in 0, 1, ... positions before ``levels`` are through.

    The buckets that hold both sets are a branching process: in each, every position is drawn with the share 1 /
    (similarity * POSITIONS), and one at random if none is.
    """
    agree, share = np.arange(POSITIONS + 1) / POSITIONS, 1 / (similarity * POSITIONS)
    none, out = (1 - share) ** POSITIONS, np.zeros(POSITIONS + 1)
    for _ in range(levels):
        out = (1 - share * agree * (1 - out)) ** POSITIONS - none * agree * (1 - out)
    return out


def runs_needed(similarity: float, recall: float, levels: int = 3) -> int:
    """Runs until a pair at ``similarity`` that must be split ``levels`` times is found with probability ``recall``."""
    chance, apart_, runs = agreements(similarity), missed(similarity, levels), 1
    least = least_agreeing(similarity, recall)
    while (chance[least:] * (1 - apart_[least:] ** runs)).sum() < recall:
        runs += 1
    return runs


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    with np.errstate(over="ignore"):
        return int(mix64(hashes).sum(dtype=np.uint64).astype(np.int64)), int(mix64(hashes ^ _B[0]).sum(dtype=np.uint64).astype(np.int64))


def text_mark() -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), h1, h2 (a hash of the shingle set), n (its size) and sig (its embedding) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch[1]]
            h1, h2 = zip(*map(set_hash, sets)) if sets else ((), ())
            n = np.array([len(s) for s in sets], np.int32)
            sig = [embed(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n), pa.array(sig, pa.binary())], ["doc_id", "mark", "h1", "h2", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_mark().alias("mark")).mapInArrow(run, "doc_id long, mark long, h1 long, h2 long, n int, sig binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, POSITIONS)


def _child(node: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The node that sets with ``value`` in position ``at`` go to."""
    with np.errstate(over="ignore"):
        return mix64(mix64(node + np.uint64(0x632BE59BD9B4E019)) ^ ((at.astype(np.uint64) << np.uint64(32)) + value)).astype(np.int64)


def _first_level(sets: DataFrame, similarity: float, runs: range) -> DataFrame:
    """(key, id, component) of each set in the children of each run's root; these sample the same positions for all sets."""
    roots = mix64(np.array(runs, np.uint64))
    which, at = np.nonzero(chosen(roots, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = _child(roots[which], at, _matrix(batch[1])[:, at].astype(np.uint64))
                again = [pa.array(np.repeat(batch[k].to_numpy(), len(at))) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *again], ["key", "id", "component"])

    return sets.select("id", "sig", "component").mapInArrow(run, "key long, id long, component long")


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, id, component) of each set in each of its node's children; rows: key, id, component, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                node = batch[0].to_numpy().astype(np.uint64)
                row, at = np.nonzero(chosen(node, similarity))
                keys = _child(node[row], at, _matrix(batch[3])[row, at].astype(np.uint64))
                again = [batch[k].take(pa.array(row)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *again], ["key", "id", "component"])

    return rows.select("key", "id", "component", "sig").mapInArrow(run, "key long, id long, component long")


def in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Deal the rows of each key to the pairs of its blocks: adds unit (a hash) and side.

    ``blocks`` names the column with the key's number of blocks; one block makes one unit. Side 0 and 1 stand for the
    two blocks of a pair, 2 for a block compared with itself.
    """
    mine = F.pmod(F.xxhash64(F.col("id")), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    placed = rows.withColumn("_mine", mine).withColumn("_other", other)
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    unit = F.when(F.col(blocks) == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    return placed.withColumn("side", side).withColumn("unit", unit).drop("_mine", "_other", blocks)


def _links_by_estimate(rows: DataFrame, agreeing: int) -> DataFrame:
    """Candidate links between components inside units, as a forest (a, b); rows: unit, side, id, component, n, sig."""
    least = agreeing / POSITIONS

    def compare(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        sig = _matrix(rows.column("sig"))
        n, side, ids, group = (rows.column(c).to_numpy() for c in ("n", "side", "id", "component"))
        found = [np.empty((2, 0), np.int64)]
        for left, right in pairs_within(starts, len(sig), 100_000):
            near = np.minimum(n[left], n[right]) >= least * np.maximum(n[left], n[right])  # else they cannot be so alike
            near &= group[left] != group[right]
            near &= (side[left] != side[right]) | (side[left] == 2)
            left, right = left[near], right[near]
            alike = (sig[left] == sig[right]).sum(axis=1) >= agreeing
            found.append(np.stack([left[alike], right[alike]]))
        left, right = np.concatenate(found, axis=1)
        root = local_roots(len(sig), left, right)
        a = np.flatnonzero(root != np.arange(len(sig)))
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[root[a]])], ["a", "b"])

    return runs_of_groups(rows, "unit", 20_000, compare, "a long, b long")


def _search(sets: DataFrame, similarity: float, runs: range, agreeing: int, pairs: int, keep: Scratch) -> tuple[DataFrame, int]:
    """A forest (a, b) over the pairs of sets that these runs bring together and the estimate does not exclude; and the levels split.

    Sets that are in one component already need no link, so buckets of one component are left out. ``pairs`` is what large
    buckets may cost together, from the level ``LEVELS`` on, without being split again.
    """
    level, found, near, before = _first_level(sets, similarity, runs), [], sets, math.inf
    large = F.col("size") > BUCKET
    while True:
        depth = len(found) + 1
        level = keep.stored(level, "paths")
        size = level.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("size > 1 and lo < hi")
        shared = keep.stored(level.join(size.select(apart(F.col("key")).alias("key"), "size"), "key"), "shared-paths")
        if depth == 1:  # what shares no bucket now shares none below
            near = keep.stored(sets.join(shared.select("id").distinct().hint("merge"), "id"), "sharing-sets")
        last = False
        if depth >= LEVELS:
            cost = float(shared.where(large).agg((F.sum("size") / 2).alias("pairs")).first().pairs or 0)
            last, before = cost <= pairs or cost > HELPS * before, cost
        ready = shared if last else shared.where(~large)
        blocks = F.when(large, F.ceil(F.col("size") / BLOCK)).otherwise(1)
        placed = in_blocks(ready.select("key", "id", "component", blocks.alias("blocks")), "blocks")
        found.append(keep.stored(_links_by_estimate(placed.join(near.select("id", "n", "sig"), "id"), agreeing).distinct(), "candidates"))
        deeper = shared.where(large)
        if last or deeper.isEmpty():
            break
        level = _children(deeper.hint("merge").join(near.select("id", "sig"), "id"), similarity)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, len(found)


def candidates(sets: DataFrame, similarity: float, recall: float, keep: Scratch) -> DataFrame:
    """(id, component): groups of sets that hold every candidate pair, but for a chance of 1 - ``recall`` at the threshold.

    The first runs find most groups; the others only look for what joins two of these. How many there must be follows
    from the levels that were needed, ``LEVELS`` at least.
    """
    agreeing, known, edges, deepest, done = least_agreeing(similarity, recall), sets.withColumn("component", F.col("id")), None, LEVELS, 0
    last, each = min(2, runs_needed(similarity, recall, LEVELS)), PAIRS * sets.count()
    while True:
        own = Scratch(sets.sparkSession)
        found, levels = _search(known, similarity, range(done + 1, last + 1), agreeing, each * (last - done), own)
        groups = components(found if edges is None else edges.unionByName(found), keep)
        own.clear()
        deepest, done = max(deepest, levels), last
        last = runs_needed(similarity, recall, deepest)
        if done >= last:
            return groups
        edges = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        known = keep.stored(sets.join(groups.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "grouped-sets")


def shared_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many shingles each two of some sets share."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(place, minlength=len(values)) > 1  # what one set holds alone is shared by none
    number = np.cumsum(often) - 1
    owner, place = owner[often[place]], number[place[often[place]]]
    total = int(often.sum())
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for k in range(0, total, width):
        a, b = np.searchsorted(place, [k, k + width])
        dense = np.zeros((len(sets), min(width, total - k)), np.float32)
        dense[owner[a:b], place[a:b] - k] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _exact_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, root, links) of the sets that have links inside units; rows: unit, side, id, copies, hashes."""

    def compare(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, side, copies = (rows.column(c).to_numpy() for c in ("id", "side", "copies"))
        sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        out: list[np.ndarray] = []
        for a, b in zip(starts, np.append(starts[1:], len(ids))):
            once = np.sort(np.unique(ids[a:b], return_index=True)[1]) + a  # an id that stands in several rows counts once
            if len(once) < 2:
                continue
            own = [sets[k] for k in once]
            both = shared_counts(own)
            n = np.array([len(s) for s in own])
            linked = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            s = side[once]
            linked &= (s[:, None] != s[None, :]) | (s[:, None] == 2)
            left, right = np.nonzero(np.triu(linked))
            if len(left):
                root = local_roots(len(own), left, right)
                has = np.flatnonzero(linked.any(axis=1))
                out.append(np.stack([ids[once][has], ids[once][root[has]], (linked @ copies[once])[has]]))
        if not out:
            return None
        columns = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "root", "links"])

    return runs_of_groups(rows, "unit", 1_000, compare, "id long, root long, links long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """For each row: doc_id, class_id, copy_id, n_links, n_shingles.

    Words are as in the other operators; a text of fewer than ``width`` words, but not none, has one shingle. Two
    documents are linked if their shingle sets have a Jaccard similarity of ``similarity`` or more; class_id is the
    smallest id that links lead to, copy_id the smallest id with the same shingles, n_links the number of other
    documents linked directly, those with the same shingles included. A pair at the threshold is found with a
    probability of ``recall``, more alike ones with more; no unlike pair is linked. Texts without words (null and empty
    ones) and rows without id link with nothing. Rows that share an id are documents of their own. An empty table gives
    no rows; further columns are ignored.
    """
    return near_duplicate_rows(docs, similarity, width, recall).drop("mark", "set_class")


def near_duplicate_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """``near_duplicates`` with mark, the ``text_mark`` of each row's text, and set_class, which names the class where rows share ids.

    The nodes of the search are distinct sets.
    """
    keep = Scratch(docs.sparkSession)
    seen = keep.stored(signatures(docs, width), "signatures")
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    first = F.min(F.struct("doc_id", "mark")).alias("first")  # a row that has the set's text
    sets = seen.where(linkable).groupBy("h1", "h2", "n").agg(first, F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    sets = keep.stored(sets.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "n", F.col("first.doc_id").alias("doc"), F.col("first.mark").alias("mark"), "copies", "sig"), "sets")
    groups = candidates(sets.select("id", "n", "sig"), similarity, recall, keep)
    sizes = keep.stored(groups.join(sets.select("id", "h1", "doc", "mark", "n", "copies"), "id"), "groups")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    placed = sizes.join(sizes.groupBy("component").agg(blocks.alias("blocks")).select(apart(F.col("component")).alias("component"), "blocks"), "component")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch[5]]
            right = pa.array([set_hash(s)[0] == h for s, h in zip(sets, batch[4].to_pylist())], pa.bool_())
            columns = [*batch.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "blocks", "id", "copies", "hashes"]).filter(right)

    # texts that are in no group stay where they are
    place = F.xxhash64("doc", "mark")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), text_mark().alias("mark"), "text")
    texts = Sieve(sizes, place, sizes.count()).passed(rows, place).join(placed.hint("merge"), ["doc", "mark"])
    columns = texts.select(F.col("component").alias("key"), "blocks", "id", "copies", "h1", "text")
    whole = columns.mapInArrow(hashes, "key long, blocks long, id long, copies long, hashes binary")
    links = keep.stored(_exact_links(in_blocks(whole, "blocks"), similarity), "links")
    classes = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), keep)
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    members = classes.join(sets.select("id", "doc").hint("merge"), "id")
    smallest = members.groupBy("component").agg(F.min("doc").alias("class")).select(apart(F.col("component")).alias("component"), "class")
    named = members.join(smallest.hint("merge"), "component").select("id", "component", "class")
    known = sets.select("id", "h1", "h2", "n", "doc", "copies").join(named, "id", "left").join(counted, "id", "left").withColumn("set_class", F.coalesce("component", "id")).drop("id", "component")
    out = seen.drop("sig").join(known, ["h1", "h2", "n"], "left")
    alone = ~F.coalesce(linkable, F.lit(False)) | F.col("doc").isNull()
    found = out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class", "doc")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("doc")).alias("copy_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("n").cast("long").alias("n_shingles"),
        "mark",
        "set_class",
    )
    return keep.result(found, "near-duplicates")
