"""Lineage against a walk up from each record."""

import random

from quillspark.operators.lineage import lineage
from quillspark.plans.folders import Kept


def plain(rows):
    parent, digest, out = {p: up for p, up, _ in rows}, {p: h for p, _, h in rows}, {}
    for path, up, own in rows:
        at, chain, seen = path, [], {path}
        while up is not None and up in parent and up not in seen:
            at, up = up, parent[up]
            seen.add(at)
            chain.append(digest[at])
        if up is not None and up in parent:
            out[path] = (None, None, None, "cycle")
        else:
            out[path] = (at, len(chain), chain, "recursive" if own in chain else "orphan" if up is not None else "ok")
    return out


def test_lineage_against_a_walk(spark, tmp_path):
    random.seed(3)
    chain = [(f"c{k}", f"c{k - 1}" if k else None, f"h{k}") for k in range(150)]  # eight rounds
    wide = [(f"w{k}", "c149" if k % 2 else "c0", "hw") for k in range(300)]  # parents of many
    odd = [("self", "self", "x"), ("r1", "r2", "a"), ("r2", "r3", "b"), ("r3", "r1", "c"), ("tail", "r2", "d"), ("tail2", "tail", "e"), ("orphan", "nowhere", "f"), ("child", "orphan", "g"), ("again", "c10", "h4")]
    trees = [(f"t{k}", f"t{random.randrange(k)}" if k and random.random() < 0.9 else None, random.choice("pqrstuv")) for k in range(200)]
    rows = chain + wide + odd + trees
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "source_path string, parent_source string, source_hash string, status string")
    found = lineage(df, Kept(spark, str(tmp_path)).store)
    assert found.columns == ["source_path", "parent_source", "source_hash", "status", "root", "depth", "ancestors", "state"]
    assert {r.source_path: (r.root, r.depth, r.ancestors, r.state) for r in found.collect()} == plain(rows)
    assert len(list((tmp_path).glob("lineage-*"))) <= 10


def test_lineage_of_nothing(spark, tmp_path):
    assert lineage(spark.createDataFrame([], "source_path string, parent_source string, source_hash string"), Kept(spark, str(tmp_path)).store).count() == 0
