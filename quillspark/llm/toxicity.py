"""Toxic passages by maximum-scoring segments.

Word forms (whole words, their first three to six and last four and five letters) get log-odds between labelled toxic
and clean documents under an informative Dirichlet prior; those that are large and significant score, every other
word costs a small drift. One linear scan finds all maximal segments of a document (Ruzzo and Tompa). Karlin-Altschul
statistics turn a segment's score and the document's length into an extreme-value significance, and a logistic curve
over these, fitted on the same documents, gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import Scratch

_WORDS = re.compile(r"[^\W_]+")
#: Documents counted before a task passes its counts on; words remembered while scoring.
FLUSH, MEMO = 2_000, 200_000


def forms(word: str) -> list[str]:
    """The forms under which a lower-cased word is counted."""
    out = [f"^{word}$"]
    out += [f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n]
    out += [f"{word[-n:]}$" for n in (4, 5) if len(word) >= n]
    return out


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, end word, score), in linear time.

    positions and scores are those of the words that gain; each word between them costs ``drift``.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, left sum, right sum, link to the left
    total, last = 0.0, -1
    for at, gain in zip(positions, scores):
        total -= drift * (at - last - 1)
        first, left = at, total
        total += gain
        last, right = at, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, at + 1, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, r - s) for f, e, s, r, _ in stack]


@dataclass
class ToxicModel:
    """Word-form scores, the scale of the extreme-value statistics, and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    rate: float = 1.0
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def word(self, word: str) -> float:
        """Gain of a word: that of its best form, 0 if none has one."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = max([self.scores.get(f, 0.0) for f in forms(word)])
        return found

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and each maximal segment with its normalised score (its negative log E-value)."""
        words = _WORDS.findall(text.lower()) if text else []
        gains = list(map(self.word, words))
        at = [i for i, g in enumerate(gains) if g]
        found = maximal_segments(at, [gains[i] for i in at], self.drift) if at else []
        size = math.log(max(len(words), 1))
        return len(words), [(f, e, self.rate * s - size) for f, e, s in found]

    @staticmethod
    def evidence(segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The best segment's significance -ln P, and the sum over all segments, both on a log scale; P = 1 - exp(-E)."""
        good = [s if s > 30 else -math.log(-math.expm1(-math.exp(-s))) if s > -3.5 else 0.0 for _, _, s in segments]
        return (math.log1p(max(good)), math.log1p(sum(good))) if good else (0.0, 0.0)

    def score(self, segments: list[tuple[int, int, float]]) -> float:
        best, total = self.evidence(segments)
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * total
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and z-scores of counts under a Dirichlet prior proportional to the counts of both classes together."""
    alpha = prior * (toxic + clean)
    mass = prior * (n_toxic + n_clean)
    delta = np.log((toxic + alpha) / (n_toxic + mass - toxic - alpha)) - np.log((clean + alpha) / (n_clean + mass - clean - alpha))
    return delta, delta / np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))


def decay(gains: np.ndarray, counts: np.ndarray, others: float, drift: float) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 for the scores of words in clean documents.

    counts: how often each gain occurs there; others: how many words gain nothing. One more of the largest is assumed.
    """
    p = np.concatenate([counts, [1.0, others]]) / (counts.sum() + others + 1.0)
    s = np.concatenate([gains, [gains.max(initial=1.0), 0.0]]) - drift
    if (p * s).sum() >= 0:  # scores that gain on the average have no extreme-value limit
        return 0.1
    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.logaddexp.reduce(np.log(np.maximum(p, 1e-300)) + mid * s) < 0 else (low, mid)
    return max(low, 0.1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression with a free intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int) -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows, the first by a hash of their id; each distinct text once.

    Rows without id, label or text teach nothing. The ids are few by that bound and go to all executors. Of several
    texts under one id the least by hash stands for it, so rows are bounded too; of several labels of one text or id the
    largest counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), "text")
    one = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    return one.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 12_000, prior: float = 0.1, least_docs: int = 3, least_z: float = 3.0, least_odds: float = 1.5, drift: float = 0.05) -> ToxicModel:
    """Learn a model from at most ``sample`` labelled rows with ``usable``. Without toxic labels all scores are near 0."""
    keep = Scratch(docs.sparkSession)
    rows = keep.stored(training_rows(docs, labels, "toxic", usable, sample), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        seen = 0

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in counts)], ["form", "clean", "toxic"])
            counts[0].clear(), counts[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch[0], batch[1].to_pylist()):
                found = [f for w in set(_WORDS.findall(text.as_py().lower())) for f in forms(w)]
                counts[int(y > 0)].update(found)
                seen += 1
                if seen % FLUSH == 0:
                    yield flush()
        yield flush()

    summed = keep.stored(rows.mapInArrow(count, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-forms")
    n_clean, n_toxic = (float(x or 0) for x in summed.agg(F.sum("clean"), F.sum("toxic")).first())
    model = ToxicModel(drift=drift)
    if not n_toxic:
        keep.clear()
        return model
    table = summed.where((F.col("toxic") >= least_docs) & (F.col("toxic") * (n_clean + 1) > F.col("clean") * n_toxic)).toPandas()
    toxic, clean = table.toxic.to_numpy(float), table.clean.to_numpy(float)
    delta, z = log_odds(toxic, clean, n_toxic, n_clean, prior)
    good = (z >= least_z) & (delta >= least_odds)
    model.scores = dict(zip(table.form[good], delta[good].tolist()))
    per_word = len(forms("abcdef"))
    model.rate = decay(delta[good], clean[good] / per_word, n_clean / per_word, drift)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [model.evidence(model.segments(t.as_py())[1]) for t in batch[0]]
            yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)), batch[1]], ["best", "total", "y"])

    seen = rows.mapInArrow(evidence, "best double, total double, y int").toPandas()
    model.curve = tuple(logistic(seen[["best", "total"]].to_numpy(), (seen.y > 0).to_numpy(float)).tolist())
    keep.clear()
    return model


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Add score, predicted and the significant passages (word ranges with -ln E) to each row of ``docs``.

    ``keep`` names the columns that stay (doc_id unless given), except those named like a result. Whole texts are scanned; null and empty texts have no
    passages and the score of a text without evidence. Null ids and repeated rows are scored like any others; an
    empty table gives an empty result.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "predicted", "passages")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("_text"))
    at = keep.index("text") if "text" in keep else len(keep)
    found_type = T.StructType.fromDDL("score double, predicted int, passages array<struct<first:int,end:int,bits:double>>")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.segments(t.as_py())[1] for t in batch[at]]
            scores = [model.score(s) for s in found]
            passages = pa.array([[{"first": f, "end": e, "bits": b} for f, e, b in s if b > 0] for s in found], kind)
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), predicted, passages], [*keep, "score", "predicted", "passages"])

    return columns.mapInArrow(run, T.StructType([*columns.schema[: len(keep)], *found_type]))
