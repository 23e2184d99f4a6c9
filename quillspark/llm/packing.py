"""Sequence packing by non-negative least squares.

A partition's documents are tokenised once and packed in blocks of bounded size, without a shuffle. In a block,
whole windows are cut off long documents first. The remainders are counted in length classes; shallow combinations
of two to four classes whose least lengths fill the window exactly are enumerated, non-negative least squares finds
how often to use each so that the histogram is met, and the rounded counts are laid out. What a sequence has above
the window is cut off its last piece; these ends and the classes that rounding left over are packed greedily, cutting
at each window's end. The last open window of a block is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.piece_memo import PieceMemo, split_words

#: Bytes of words remembered in a worker; tokens and documents after which a block is packed.
MEMO, BLOCK_TOKENS, BLOCK_DOCS = 16 << 20, 6_000_000, 50_000
#: Unicode white space (fixed values), as the pre-tokenizer's \s has it.
WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The pre-tokenizer of the byte-level vocabulary (fixed values).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    Cut before a space between two other characters, a text keeps its ids: the pre-tokenizer never crosses such a
    place, and added tokens hold no space. Words are merged by a second, faster implementation over the same
    vocabulary; texts with added tokens, or with other white space beside a space, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        ranks = {bytes(map(alphabet.__getitem__, p)): i for p, i in vocab.items() if p not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        #: Ids in the order of the merges let the faster implementation stand in.
        self.plain = order == sorted(order) and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space") and spec["normalizer"] is None and not any(" " in t for t in self.added)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for p, i in ranks.items() if p[:1] == b" "]] = True
        self.memo = PieceMemo(self._merge, ["the"], MEMO)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each have one space before them and none inside."""
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        return ids, np.diff(np.append(starts, len(ids)))

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = "|".join(("".join("\\" + c if not c.isalnum() else c for c in t)) for t in self.added)
        odd = pc.match_substring_regex(texts, f"^ | $|[{WHITE}] | [{WHITE}]" + f"|{special}" * bool(special))
        odd = np.asarray(odd.to_numpy(zero_copy_only=False)) if self.plain else np.ones(len(texts), bool)
        plain = np.flatnonzero(~odd & np.asarray(pc.not_equal(texts, "").to_numpy(zero_copy_only=False)))
        lens, parts = np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(odd):
            parts[i] = self.alone(texts[i].as_py())
        if len(plain):
            codes, n_words, words = split_words(texts.take(pa.array(plain)))
            first = np.cumsum(n_words) - n_words
            slots = self.memo.slots(words)[codes]
            rest = np.delete(slots, first)  # a text's first word has no space before it
            heads = words.take(pa.array(codes[first])).to_pylist()
            ids, per_word = self.memo.gather(rest)
            ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(n_words - 1)]
            begin = 0
            for i, head, end in zip(plain, heads, ends):
                parts[i] = np.concatenate([np.array(self.fast.encode_ordinary(head), np.uint32), ids[begin:end]])
                begin = end
        lens[:] = [len(p) for p in parts]
        return np.concatenate([*parts, np.empty(0, np.uint32)]), lens


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer per worker and file."""
    return ByteTokenizer(path)


@lru_cache(maxsize=4)
def combinations(classes: int, depth: int) -> np.ndarray:
    """Multisets of 2 to ``depth`` classes 1..classes-1 that add up to ``classes``, as columns of class counts."""
    found: list[list[int]] = []

    def extend(picked: list[int], left: int) -> None:
        if left == 0 and len(picked) > 1:
            found.append(picked)
        elif len(picked) < depth:
            for c in range(picked[-1] if picked else 1, left + 1):
                if c == left or len(picked) + 1 < depth:
                    extend([*picked, c], left - c)

    extend([], classes)
    out = np.zeros((classes, len(found)))
    for k, picked in enumerate(found):
        np.add.at(out[:, k], picked, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that makes ||a x - b|| least, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds or 3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[best] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min(initial=1) > 0:
                break
            low = passive & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                z = x
                break
        x = z
    return x


def pack(lengths: np.ndarray, window: int = 2048, classes: int = 64, depth: int = 3) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that place every token of every document once.

    Sequences are filled to ``window``, but for the powers of two at the end. ``window`` must be a power of two and a
    multiple of ``classes``. Documents of no tokens get no piece.
    """
    unit = window // classes
    pieces: list[np.ndarray] = []
    lengths = np.asarray(lengths, np.int64)
    whole = lengths // window
    docs = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(docs)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces.append(np.stack([docs, nth * window, np.full_like(docs, window), np.arange(len(docs)), np.zeros_like(docs)], 1))
    sequence = len(docs)

    left = np.flatnonzero(lengths % window)
    rest = np.stack([left, whole[left] * window, (lengths % window)[left]], 1)
    by_class = [list(map(tuple, rest[rest[:, 2] // unit == c][::-1])) for c in range(classes)]
    histogram = np.array([0, *map(len, by_class[1:])], float)
    combos = combinations(classes, depth)
    used = combos.any(axis=1)
    x = nnls(combos[used], histogram[used], 40 * classes)
    ends: list[tuple[int, int, int]] = []
    placed: list[tuple[int, int, int, int, int]] = []
    for k in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
        picks = np.repeat(np.arange(classes), combos[:, k].astype(int))
        need = np.bincount(picks, minlength=classes)
        for _ in range(int(x[k] + 0.5)):
            if any(len(by_class[c]) < need[c] for c in set(picks.tolist())):
                break
            offset = 0
            for c in picks.tolist():
                doc, start, length = by_class[c].pop()
                take = min(length, window - offset)
                placed.append((doc, start, take, sequence, offset))
                offset += take
                if take < length:
                    ends.append((doc, start + take, length - take))
            sequence += 1

    greedy = [p for c in by_class[::-1] for p in c] + ends
    total, open_at = sum(p[2] for p in greedy), 0
    tail = total % window
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if tail >> b & 1]
    size = iter(sizes)
    room = next(size, 0)
    for doc, start, length in greedy:
        while length:
            if open_at == room:
                room, open_at, sequence = next(size), 0, sequence + 1
            take = min(length, room - open_at)
            placed.append((doc, start, take, sequence, open_at))
            open_at, start, length = open_at + take, start + take, length - take
    if placed:
        pieces.append(np.array(placed, np.int64))
    out = np.concatenate(pieces).astype(np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


PACKED = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pack every document's ids, and ``end_id`` after them, into sequences of ``window`` tokens; a row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless ``with_ids`` is false, the
    piece's ids. A null or empty text has ``end_id`` alone. Rows that share an id are packed as documents of their own,
    rows with a null id too. An empty table gives no rows; further columns are ignored. Texts have no limit of length:
    one longer than a block makes a block by itself. Sequence ids are made of the partition's and the block's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        context = TaskContext.get()
        base, next_id = (context.partitionId() if context else 0) << 40, 0
        held_ids: list[np.ndarray] = []
        held_docs: list[pa.Array] = []
        held_lens: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            ids, lens = np.concatenate(held_ids), np.concatenate(held_lens)
            doc_ids = pa.concat_arrays(held_docs)
            held_ids.clear(), held_docs.clear(), held_lens.clear()
            rows = pack(lens, window)
            begin = (np.cumsum(lens) - lens)[rows[:, 0]] + rows[:, 1]
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), rows[:, 2].tolist())]
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                columns = [doc_ids.take(pa.array(part[:, 0])), part[:, 1], part[:, 2], np.array(crcs[k : k + 20_000], np.int64), lens[part[:, 0]], base + next_id + part[:, 3], part[:, 4]]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    where = np.repeat(begin[k : k + 20_000] - (np.cumsum(part[:, 2]) - part[:, 2]), part[:, 2]) + np.arange(part[:, 2].sum())
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(part[:, 2])]), pa.int32()), pa.array(ids[where].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [*PACKED.names, *["ids"] * with_ids])
            next_id += int(rows[:, 3].max()) + 1

        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                ids, lens = encode.ids(part[1])
                full = np.full(len(ids) + len(lens), end_id, np.uint32)
                where = np.arange(len(ids)) + np.repeat(np.arange(len(lens)), lens)
                full[where] = ids
                held_ids.append(full), held_docs.append(part[0]), held_lens.append(lens + 1)
                if sum(map(len, held_ids)) >= BLOCK_TOKENS or sum(map(len, held_lens)) >= BLOCK_DOCS:
                    yield from flush()
        if held_ids:
            yield from flush()

    schema = ", ".join(f"{n} long" for n in PACKED.names) + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)
