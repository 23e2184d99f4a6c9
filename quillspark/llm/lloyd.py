"""Centroid clustering by plain Lloyd rounds over integer vectors, exact at every step.

Centroids are broadcast; each partition computes integer squared differences per centroid, assigns each vector to the
nearest and sums the components of what it assigned; the sums of all partitions are merged by a groupBy. What reaches the
driver is one row for each centroid and component, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch
from quillspark.llm.whole_vectors import numbers, packed, unpacked, whole

#: Vectors compared with all centroids at once in a task.
CHUNK = 8192


def kept_vectors(vectors: DataFrame, width: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, vector): the vectors of exactly ``width`` usable components, as integers packed in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in whole(batch[1], scale):
                if values.shape[1] == width and len(rows):
                    yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), packed(values)], ["vec_id", "vector"])

    return vectors.select(F.col("vec_id").cast("long"), numbers(vectors)).mapInArrow(run, "vec_id long, vector binary")


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<salt>:<vec_id>``, in ascending order; of a repeated id's rows, by their bytes."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.where("vec_id is not null").select(digest.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return unpacked([bytes(r.vector) for r in seeds])


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids, the one with the smallest number."""
    cluster, distance = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        squares = np.empty((len(centroids), len(part)), np.int64)
        for c, centroid in enumerate(centroids):
            difference = part - centroid
            squares[c] = np.einsum("ij,ij->i", difference, difference)
        cluster[at : at + CHUNK] = squares.argmin(axis=0)
        distance[at : at + CHUNK] = squares.min(axis=0)
    return cluster, distance


def moved_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means of what each is nearest to; empty ones stay."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        total, count = np.zeros_like(at), np.zeros(len(at), np.int64)

        def out() -> pd.DataFrame:
            cluster, component = np.divmod(np.arange(total.size), total.shape[1])
            return pd.DataFrame({"cluster": cluster, "component": component, "total": total.ravel(), "count": count[cluster]})

        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            if rows + len(batch) > 1 << 32:  # a component is below 2**30, so sums of that many fit a long
                yield out()
                total, count, rows = np.zeros_like(at), np.zeros(len(at), np.int64), 0
            values = unpacked(batch.vector.to_numpy())
            cluster, _ = nearest(values, at)
            for c in np.unique(cluster):
                mine = cluster == c
                total[c] += values[mine].sum(axis=0)
                count[c] += int(mine.sum())
            rows += len(batch)
        if rows:
            yield out()

    parts = kept.select("vector").mapInPandas(sums, "cluster int, component int, total long, count long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("total", "count")]
    moved = centroids.copy()
    for r in parts.groupBy("cluster", "component").agg(*exact).where("count > 0").collect():
        moved[r.cluster, r.component] = int(r.total) // int(r["count"])
    shared.unpersist()
    return moved


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """For each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of longs), centroid_sha256.

    Kept are the vectors of exactly ``width`` components, none of them null or non-finite, each component x taken as
    floor(``scale`` * x); one whose integers have a length of 2**30 or more isn't kept either, as squares of its distances
    need not fit a long. Centroids start as the kept vectors with the smallest sha256 of ``<salt>:<vec_id>``: fewer than
    ``k`` if fewer are kept, and those of a repeated id ordered by their bytes. Rows with a null id are no first centroids,
    but are assigned like others (if all ids are null there is no centroid and no row). A round that moves no centroid ends
    the rounds, as no later one would move any. Distances are squared; sums beyond a long are null. Rows that repeat
    are vectors of their own; an empty table gives no rows; further columns are ignored.
    """
    spark, keep = vectors.sparkSession, Scratch(vectors.sparkSession)
    kept = keep.stored(kept_vectors(vectors, width, scale), "kept-vectors")
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        kept = kept.limit(0)
        centroids = np.zeros((1, width), np.int64)
    else:
        for _ in range(rounds):
            before, centroids = centroids, moved_centroids(kept, centroids)
            if np.array_equal(before, centroids):
                break
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(unpacked(batch.vector.to_numpy()), shared.value)
                yield pd.DataFrame({"vec_id": batch.vec_id.astype("Int64"), "cluster": cluster, "distance": distance})

    assigned = keep.stored(kept.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    per = assigned.groupBy("cluster").agg(exact.alias("own")).collect()  # one row for each centroid
    whole_sum = sum(int(r.own) for r in per)
    fits = lambda n: n if n < 1 << 63 else None
    rows = [
        (r.cluster, fits(int(r.own)), fits(whole_sum), centroids[r.cluster].tolist(), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
        for r in per
    ]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return keep.result(assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"), "lloyd")
