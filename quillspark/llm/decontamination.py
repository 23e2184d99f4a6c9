"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of consecutive item words. For windows of one length, a shift table over two-word
blocks says how far the search may skip when a block ends at the present place; a shift of nought leads to the
bucket of the windows that end in that block, and a direct comparison of words confirms an occurrence.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, unused, words_of

#: Words of benchmark items searched for in one pass, about; more are searched for in further passes over the documents.
BLOCK_WORDS = 250_000


class WuManber:
    """Finds every occurrence of the windows of some items in a list of words.

    items: (item id, text) pairs. An item has a window at each run of ``window`` words, or one of all its words if
    they are fewer; an item without words has none.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = 8):
        owners: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                owners[size][tuple(words[k : k + size])].add(item)
        self.vocabulary: dict[bytes, int] = {}
        self.searches = []
        for size, windows in sorted(owners.items()):
            for words in windows:
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        scale = self.scale = len(self.vocabulary) + 1
        for size, windows in sorted(owners.items()):
            shift: dict[int, int] = {}
            buckets: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(dict)
            for words, ids in windows.items():
                codes = tuple(map(self.vocabulary.__getitem__, words))
                for k, code in enumerate(codes):
                    if k or size == 1:
                        block = code * scale + (codes[k - 1] if k else 0)
                        shift[block] = min(shift.get(block, size), size - 1 - k)
                buckets[block][codes] = sorted(ids)
            self.searches.append((size, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (first, end) of all occurrences, and the items found."""
        codes = list(map(self.vocabulary.get, words))
        n, scale, ranges, items = len(codes), self.scale, [], set()
        for size, shift, buckets in self.searches:
            at, skip = size - 1, max(1, size - 1)
            while at < n:
                code = codes[at]
                if code is None:  # no window holds this word
                    at += size
                    continue
                before = (codes[at - 1] or 0) if size > 1 else 0
                block = code * scale + before
                step = shift.get(block, skip)
                if step == 0:
                    found = buckets[block].get(tuple(codes[at - size + 1 : at + 1]))
                    if found:
                        ranges.append((at - size + 1, at + 1))
                        items.update(found)
                    step = 1
                at += step
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def excise(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for first, end in ranges:
        kept.append(raw[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


_ITEMS: dict[str, list[tuple[str, str]]] = {}


@lru_cache(maxsize=1)
def _built(key: str, window: int) -> WuManber:
    return WuManber(list(_ITEMS[key]), window)


def _machine(items: Broadcast, window: int) -> WuManber:
    """The block's machine, one at a time in a worker."""
    key, rows = items.value
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = rows
    return _built(key, window)


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """The benchmark's items in blocks of about ``block_words`` words, each with whether it is the only one.

    Items without id or text hold nothing. An item stands in one block whole, however long it is.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    size = items.agg(F.sum(F.octet_length("text") / 5 + 1)).first()[0] or 0
    count = max(1, -(-int(size) // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield count == 1, [(r.item_id, r.text) for r in (items.where(block == k) if count > 1 else items).collect()]


_FOUND = "ranges array<int>, items array<string>"


def _text_key(text: str = "text") -> list:
    """What names a text where passes meet: rows of one text have one result."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def _hits(texts: DataFrame, shared: Broadcast, window: int, only: bool) -> DataFrame:
    """The columns of ``texts`` but its last, which is the text, with ranges (first, end, ...) and items; ``only`` rows with hits if asked."""
    names = texts.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared, window)
        for batch in batches:
            ranges, items, hit = [], [], []
            for text in batch[len(names)]:
                r, i = machine.search(words_of(text.as_py()))
                ranges.append([x for p in merged(r) for x in p])
                items.append(sorted(i))
                hit.append(bool(r))
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*names, "ranges", "items"])
            yield out.filter(pa.array(hit, pa.bool_())) if only else out

    return texts.mapInArrow(run, f"{schema}, {_FOUND}" if schema else _FOUND)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[Broadcast | None, DataFrame | None]:
    """A broadcast of the only block, or what passes of several blocks found: (t1, t2, ranges, items) of each text with hits.

    Each pass reads the documents, leaves its hits as a table, and lets go of its block before the next begins.
    """
    spark, parts = docs.sparkSession, []
    keep = Scratch(spark)
    for k, (alone, items) in enumerate(blocks(benchmark, block_words)):
        shared = spark.sparkContext.broadcast((f"{id(keep)}-{k}", items))
        if alone:
            return shared, None
        parts.append(keep.stored(_hits(docs.select(*_text_key(), "text"), shared, window, True).dropDuplicates(["t1", "t2"]), "hits"))
        shared.destroy()
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[2].to_pylist()
            ranges = [[x for p in merged([q for r in found for q in zip(r[::2], r[1::2])]) for x in p] for found in lists]
            items = [sorted({i for found in several for i in found}) for several in batch[3].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["t1", "t2", "ranges", "items"])

    gathered = both.groupBy("t1", "t2").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("items").alias("items"))  # one of each pass
    return None, keep.result(gathered.mapInArrow(join, f"t1 long, t2 long, {_FOUND}"), "passages")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_words: int = BLOCK_WORDS, min_items: int = 2) -> DataFrame:
    """For each document row: doc_id, n_words, n_hit, items, hit ranges and contaminated.

    A word inside any occurrence of an item's window is hit; items are those with an occurring window, sorted as
    strings; contaminated says that there are at least ``min_items``. Null and empty texts have no words; an empty
    benchmark hits nothing; equal item ids count once; repeated rows and null ids of documents give rows of their
    own; further columns are ignored. A benchmark of one block is searched for in one reading without a shuffle, a
    larger one in as many as it has blocks; neither driver nor worker ever holds more than one block.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = pa.array([sum(r[1::2]) - sum(r[::2]) for r in batch[2].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], n_hit, batch[3], batch[2]], ["doc_id", "n_words", "n_hit", "items", "ranges"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = pa.array([len(words_of(t.as_py())) for t in batch[3]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch[0], n_words, batch[1], batch[2]], ["doc_id", "n_words", "t1", "t2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared, found = _passes(rows, benchmark, window, block_words)
    if found is None:
        out = _overlaps(rows, shared, window)
    else:
        sized = rows.select("doc_id", *_text_key(), "text").mapInArrow(words, "doc_id long, n_words long, t1 long, t2 long")
        none = [F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("ranges", "array<int>"), ("items", "array<string>"))]
        out = sized.join(found, ["t1", "t2"], "left").select("doc_id", "n_words", *none).mapInArrow(counted, _OVERLAPS)
    return out.withColumn("contaminated", F.size("items") >= min_items)


_OVERLAPS = "doc_id long, n_words long, n_hit long, items array<string>, ranges array<int>"


def _overlaps(rows: DataFrame, shared: Broadcast, window: int) -> DataFrame:
    """One reading with the only block; rows: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared, window)
        for batch in batches:
            n_words, ranges, items = [], [], []
            for text in batch[1]:
                words = words_of(text.as_py())
                r, i = machine.search(words)
                n_words.append(len(words))
                ranges.append(merged(r))
                items.append(sorted(i))
            n_hit = [sum(end - first for first, end in r) for r in ranges]
            flat = [[x for p in r for x in p] for r in ranges]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(flat, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "n_hit", "items", "ranges"],
            )

    return rows.mapInArrow(run, _OVERLAPS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, action: str = "drop", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark passages, in the columns they came with.

    A document leaks if a run of at least ``window`` of its words is hit, or at least ``min_items`` items occur.
    ``action`` "drop" removes such documents; "excise" removes those with ``min_items`` items and cuts the runs out of
    the others. All other rows stay as they are: null, empty and wordless texts, null ids, and repeated rows, which are
    judged alike. An empty table or benchmark changes nothing. Columns of any name stay; after "excise" n_chars, if
    there is one, follows the text.
    """
    shared, found = _passes(docs, benchmark, window, block_words)
    at = docs.columns.index("text")

    def judged(text: str | None, ranges: list[tuple[int, int]], items: int) -> tuple[str | None, bool]:
        leaks = [r for r in ranges if r[1] - r[0] >= window]
        keep = items < min_items and not (leaks and action == "drop")
        return (excise(text, leaks) if leaks and keep else text), keep

    def cleaned(batch: pa.RecordBatch, texts: list, keep: list) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared, window)
        for batch in batches:
            texts, keep = [], []
            for text in batch.column(at).to_pylist():
                ranges, items = machine.search(words_of(text))
                new, good = judged(text, merged(ranges), len(items))
                texts.append(new)
                keep.append(good)
            yield cleaned(batch, texts, keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, r, i in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                new, good = judged(text, list(zip(r[::2], r[1::2])) if r else [], len(i or []))
                texts.append(new)
                keep.append(good)
            out = cleaned(batch, texts, keep)
            yield pa.RecordBatch.from_arrays(out.columns[:-2], schema=pa.schema(list(out.schema)[:-2]))

    if found is None:
        out = docs.mapInArrow(clean, docs.schema)
    else:
        names = [unused(n, docs.columns) for n in found.columns]
        renamed = found.toDF(*names)
        marked = docs.join(renamed, (F.xxhash64(docs["text"]) == renamed[names[0]]) & (F.xxhash64(F.lit(2), docs["text"]) == renamed[names[1]]), "left")
        out = marked.select(*(docs[c] for c in docs.columns), renamed[names[2]], renamed[names[3]]).mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if action == "excise" and "n_chars" in docs.columns else out
