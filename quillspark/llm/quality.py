"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting goes round the features in turn; each time a shallow tree
over one feature's bins is fitted to the logistic loss and added to that feature's lookup table. The pairs whose
two-way splits reduce the loss most then get tables of their own in the same way. A text's score is the sum of table
entries, read for whole batches at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.toxicity import training_rows

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "shouts", "spaces", "beyond_ascii", "distinct", "top_word",
    "repeats", "log_repeats", "log_lines", "line_copies", "line_bytes", "short_words", "capital_words", "marked_words", "entropy", "pair_copies", "longest_word",
)
_RAW = re.compile(rb"\S+")
_MARKS = np.array([chr(b) in "#$%&*+/<=>@[\\]^_`{|}~" for b in range(256)])
_ENDS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def features(text: str | None) -> np.ndarray:
    """The features of one whole text, in the order of FEATURES; a null or empty text has zeros."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words = len(raw), raw.split()
    letters = counts[65:91].sum() + counts[97:123].sum()
    share = counts[counts > 0] / size
    lines = raw.split(b"\n")
    n = max(len(words), 1)
    lowered = raw.lower().split()
    by_word = Counter(lowered)
    repeats = sum(map(bytes.__eq__, lowered[1:], lowered))
    pairs = len(set(zip(lowered, lowered[1:])))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:" for w in words)
    out[:] = (
        np.log1p(size), np.log1p(len(words)), sum(map(len, words)) / n, counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / size, counts[_MARKS].sum() / size, counts[33] / size, (counts[32] + counts[9:14].sum()) / size,
        counts[128:].sum() / size, len(by_word) / n, max(by_word.values(), default=0) / n, repeats / n, np.log1p(repeats), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)),
        sum(len(w) < 4 for w in words) / n, sum(map(bytes.isupper, words)) / n, marked / n, -(share * np.log2(share)).sum(), 1 - pairs / max(len(lowered) - 1, 1), np.log1p(max(map(len, words), default=0)),
    )
    return out


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, and tables of coarser bins for pairs of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for p in self.pairs for k in p}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values per bin of a tree with a few leaves, split where the loss falls most; g, h: sums per bin."""
    parts = [(0, len(g))]
    sums_g, sums_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            lg, lh = sums_g[a + 1 : b] - sums_g[a], sums_h[a + 1 : b] - sums_h[a]
            tg, th = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
            gain = _gain(lg, lh, ridge) + _gain(tg - lg, th - lh, ridge) - _gain(tg, th, ridge)
            gain[(lh < least) | (th - lh < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, a + 1 + k)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best split of a two-way table into four, by one cut of each axis, and its values."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        inner, right, low, total = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [inner, right - inner, low - inner, total - right - low + inner]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    qg, qh = quarters(cg), quarters(ch)
    gain = sum(_gain(a, b, ridge) for a, b in zip(qg, qh))
    gain = np.where(np.min(qh, axis=0) < least, -1.0, gain)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[r, c] < 0:
        return 0.0, np.zeros_like(g)
    out = np.empty_like(g)
    for k, (rows, cols) in enumerate(((slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)), (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None)))):
        out[rows, cols] = qg[k][r, c] / (qh[k][r, c] + ridge)
    return float(gain[r, c]), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, leaves: int = 4, ridge: float = 1.0, least: float = 0.5) -> AdditiveModel:
    """Fit by cyclic boosting: all features in turn, round after round; then the most useful pairs."""
    base = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    width = x.shape[1]
    edges = [_edges(x[:, k], bins) if len(x) else np.empty(0) for k in range(width)]
    model = AdditiveModel(float(np.log(base / (1 - base))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(x) or y.min() == y.max():
        return model
    where = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    z = np.full(len(x), model.intercept)

    def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

    for _ in range(rounds):
        for k in range(width):
            if len(edges[k]):
                step = rate * np.clip(_tree(*sums(where[k], len(edges[k]) + 1), leaves, ridge, least), -4, 4)
                model.tables[k] += step
                z += step[where[k]]
    model.pair_edges = [_edges(x[:, k], coarse) if len(np.unique(x[:, k])) > 1 else np.empty(0) for k in range(width)]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    flat = lambda i, j: cells[i] * sizes[j] + cells[j]
    split = lambda i, j: _cross(*(t.reshape(sizes[i], sizes[j]) for t in sums(flat(i, j), sizes[i] * sizes[j])), ridge, least)
    gains = sorted(((split(i, j)[0], i, j) for i, j in combinations(range(width), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j) for g, i, j in gains[:n_pairs] if g > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = rate * np.clip(split(i, j)[1], -4, 4)
            table += step
            z += step[cells[i], cells[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 12_000) -> AdditiveModel:
    """Learn from at most ``sample`` labelled rows with ``usable``; without labels of both kinds all scores are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tolist() for t in batch[0]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch[1]], ["x", "y"])

    rows = training_rows(docs, labels, "quality", usable, sample).mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES))
    y = (rows.y > 0).to_numpy(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the order rows arrive in must not matter
    return train(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for each row; one row out for each row in.

    Null and empty texts are scored by features of zero. Null ids, repeated rows and very long texts are scored like
    any others; further columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch[1]]).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
