"""Deduplication islands against a plain simulation of the slot."""

import random

from quillspark.operators.dedup import dedup_islands, seeded
from quillspark.plans.folders import Kept


def simulate(rows, seeds=()):
    slot, out = {}, {}
    for h, path, converter in sorted(seeds, key=lambda s: s[1], reverse=True):
        slot[h] = (path, converter)
    first = {h: p for h, (p, _) in slot.items()}
    for h, o, path, converter in sorted(rows, key=lambda r: r[1]):
        if h in slot and slot[h][1] == converter and first.get(h) != path:
            out[path] = slot[h][0]
        else:
            slot[h] = (path, converter)
            out[path] = None
    return out


def test_islands(spark, tmp_path):
    random.seed(5)
    rows = [(f"h{random.randint(0, 20)}", k, f"p{k:03}", random.choice("ab")) for k in range(300)]
    df = spark.createDataFrame(rows, "source_hash string, ord long, source_path string, converter string")
    assert {r.source_path: r.dedup_of for r in dedup_islands(df, Kept(spark, str(tmp_path)).store).collect()} == simulate(rows)
    seeds = [(f"h{k}", f"z{k}", "a") for k in range(0, 20, 2)] + [("h1", "p001", "b"), ("h2", "z99", "b")]
    prior = spark.createDataFrame(seeds, "source_hash string, source_path string, converter string")
    assert {r.source_path: r.dedup_of for r in seeded(df, prior, Kept(spark, str(tmp_path / "s")).store).collect()} == simulate(rows, seeds)
