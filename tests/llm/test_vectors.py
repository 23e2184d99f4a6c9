"""Clustering and exact search over integer vectors, against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from conftest import DATA

from quillspark.llm import lloyd, threshold_search
from quillspark.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, embedding array<double>"
BAD = [None, [], [1.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 0.0], [None, 0.0, 0.0, 0.0], [1e300] * 4, [1e306] * 4, [0.0] * 5]


def integers(x, width):
    if x is None or (width is not None and len(x) != width) or any(c is None or not math.isfinite(c) or abs(c) > 1e20 for c in x):
        return None
    v = [math.floor(1024 * c) for c in x]
    return v if sum(c * c for c in v) < 2**60 else None


def plain_lloyd(rows, width, k=8, rounds=10):
    kept = [(i, v) for i, x in rows if (v := integers(x, width)) is not None]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for i, v in kept if i is not None)
    at = [s[2] for s in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in kept] if at else []

    for _ in range(rounds):
        found = assign()
        for n in range(len(at)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                at[n] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    inertia = [sum(d for d, c in found if c == n) for n in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], total, sha[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def shown(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def test_lloyd_against_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((300, 4)) + rng.integers(-3, 3, (300, 1))).tolist())]
    rows += [(1000 + i, x) for i, x in enumerate(BAD)] + [(None, [1.0, 2.0, 3.0, 4.0]), (5, [9.0, 9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0, 8.0])]
    rows += [(2000 + i, [0.5, -0.5, 0.25, -0.25]) for i in range(150)] + [(3000, [500_000.0, 0.0, 0.0, 1.0])]  # a third are copies; one lies far off
    df = spark.createDataFrame([(i, 1, x) for i, x in rows], SCHEMA).withColumnRenamed("label", "cluster")
    found = lloyd.lloyd(df.repartition(7), width=4)
    assert shown(found) == plain_lloyd(rows, 4)
    assert found.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(k, [float(k % 2), 0.0]) for k in range(5)]])
def test_lloyd_of_few(spark, rows):
    """Empty tables, only unusable rows, only null ids, copies of one vector, fewer than k vectors; ties go to the smaller number."""
    df = spark.createDataFrame([(i, 0, x) for i, x in rows], SCHEMA)
    assert shown(lloyd.lloyd(df, width=2)) == plain_lloyd(rows, 2)


def test_lloyd_floats_and_centroids_that_stay_empty(spark):
    rows = [(k, [0.1, 0.1, 0.1]) for k in range(20)] + [(50 + k, [0.1, -0.7, float(k)]) for k in range(4)]
    df = spark.createDataFrame([(i, 0, x) for i, x in rows], "vec_id int, label int, embedding array<float>")
    single = [(i, np.array(x, np.float32).astype(float).tolist()) for i, x in rows]
    assert shown(lloyd.lloyd(df, width=3)) == plain_lloyd(single, 3)


def test_lloyd_query(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert shown(QUERIES["op11_lloyd"](spark, DATA)) == plain_lloyd(rows, 64)


def plain_top(rows, k=10, every=100):
    """(query's place, rank, id, score) of each query, from all scores; vectors of different widths filled with noughts."""
    kept = [(n, i, v) for n, (i, x) in enumerate(rows) if i is not None and (v := integers(x, None)) is not None]
    out = []
    for n, i, q in kept:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in kept if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def tops(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def search(spark, rows, **options):
    schema = "vec_id long, score int, embedding array<double>"
    return tops(threshold_search.top_scores(spark.createDataFrame([(i, 0, x) for i, x in rows], schema).repartition(5), **options))


def spread(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, width))
    return (centres[rng.integers(0, 4, n)] + rng.standard_normal((n, width))).round(3).tolist()


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_top_scores_against_all_scores(spark, slices):
    rows = list(enumerate(spread(400, 6, 1)))
    rows += [(1000 + k, x) for k, x in enumerate(BAD)] + [(None, [1.0] * 6), (100, [9.0] * 6), (100, [0.5] * 6), (-200, [-3.0] * 6)]
    rows += [(2000 + k, [0.5, -0.5, 0.25, -0.25, 1.0, 2.0]) for k in range(250)]  # copies, three of them queries
    rows += [(3000, [0.0] * 6), (3100, [9000.0, 1.0, 0.0, 0.0, 0.0, -9000.0]), (3101, [900_000.0] + [0.0] * 5), (3200, [1.0] * 9), (3300, [])]
    assert search(spark, rows, slices=slices) == plain_top(rows)


def test_top_scores_in_blocks_with_ties(spark, monkeypatch):
    """Few distinct scores, many queries, several blocks; every phase has work."""
    monkeypatch.setattr(threshold_search, "BLOCK", 7)
    monkeypatch.setattr(threshold_search, "CELLS", 50)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(c) for c in x]) for i, x in zip(rng.permutation(300), rng.integers(-1, 2, (300, 4)))]
    assert search(spark, rows, every=3, k=4) == plain_top(rows, 4, 3)
    far = [(k, [1.0 if c == k % 40 else 0.0 for c in range(40)]) for k in range(200)]  # nearly all scores are nought
    assert search(spark, far, every=10) == plain_top(far, every=10)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(0, [1.0, 2.0])], [(0, [1.0]), (0, [1.0]), (7, None)], [(0, [1.0]), (5, [-2.0]), (6, [3.0])]])
def test_top_scores_of_few(spark, rows):
    assert search(spark, rows) == plain_top(rows)


def test_top_scores_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert tops(QUERIES["op13_top_scores"](spark, DATA)) == plain_top(rows)
