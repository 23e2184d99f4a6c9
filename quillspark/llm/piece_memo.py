"""A bounded memo from words to token ids, looked up for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of the longest word that is remembered.
LONGEST = 64


class PieceMemo:
    """Tokens of words, computed by ``encode`` when first met and kept while they fit.

    ``encode`` takes a list of words and returns the ids of all of them in a row and the number of ids of each.
    The memo holds about ``most`` bytes at most, and no words of more than ``LONGEST`` bytes: texts without spaces are one word
    each, and seldom come again. What the present batch needs is held beside it until the next call, whatever its size. When the memo is full
    it starts again from ``base``, so results never depend on what it holds.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], base: list[str], most: int):
        self.encode, self.most = encode, most
        self.base = pa.array(base, pa.large_string())
        self.base_ids, self.base_lens = encode(base)
        self._reset()

    def _reset(self) -> None:
        self.words, self.ids, self.lens = self.base, self.base_ids, self.base_lens
        self.kept = len(self.lens), len(self.ids)

    @property
    def nbytes(self) -> int:
        """Bytes that stay from batch to batch."""
        return self.words.nbytes + 8 * self.kept[0] + self.ids.itemsize * self.kept[1]

    def slots(self, words: pa.Array) -> np.ndarray:
        """For each of some distinct words, its place in the memo; holds until the next call."""
        self.lens, self.ids = self.lens[: self.kept[0]], self.ids[: self.kept[1]]  # without what only the last batch needed
        if self.nbytes > self.most:
            self._reset()
        place = pc.index_in(words, value_set=self.words)
        if not place.null_count:
            return np.asarray(place)
        missing = np.flatnonzero(np.asarray(pc.is_null(place)))
        long = np.asarray(pc.greater(pc.binary_length(words.take(pa.array(missing))), LONGEST))
        missing = np.concatenate([missing[~long], missing[long]])  # those to be remembered first
        new = words.take(pa.array(missing))
        ids, lens = self.encode(new.to_pylist())
        place = np.array(pc.fill_null(place, -1))
        place[missing] = np.arange(len(new)) + len(self.lens)
        stay = int((~long).sum())
        self.words = pa.concat_arrays([self.words, new.slice(0, stay)])
        self.kept = self.kept[0] + stay, self.kept[1] + (int(lens[:stay].sum()) if len(ids) else 0)
        self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
        return place

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has."""
        ends = np.cumsum(self.lens)
        lens = self.lens[slots]
        shift = (ends - self.lens)[slots] - (np.cumsum(lens) - lens)
        return self.ids[np.repeat(shift, lens) + np.arange(lens.sum())], lens


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts at single spaces: a code for each word, each text's number of words, and the distinct words."""
    parts = pc.split_pattern(pc.cast(texts, pa.large_string()), " ")
    words = parts.flatten().dictionary_encode()
    return np.asarray(words.indices), np.asarray(pc.list_value_length(parts)), words.dictionary
