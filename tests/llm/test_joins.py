"""Near duplicates of texts and vectors against brute force, with nulls, ties and copies."""

import contextlib
import itertools
import math
import os
import random
import threading
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillspark.llm import chosen_path, projection_forest
from quillspark.llm.common import Scratch, Sieve, shared_dir, shingles, words_of
from quillspark.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(docs, width=5):
    sets = {}
    for d, t in docs:
        w = words_of(t)
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def corpus(seed=3):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(random.randint(3, 120))] for _ in range(40)]
    docs = []
    for k in range(400):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = word()
        docs.append((k, " ".join(words)))
    return docs + [(900, None), (901, ""), (902, "!!!"), (903, "one"), (904, "One."), (905, "x " * 30_000)]


def check(found, docs, links):
    want, count = roots([d for d, _ in docs], links), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {r.doc_id: r.class_id for r in found} == want
    assert {r.doc_id: r.n_links for r in found} == {d: count[d] for d, _ in docs}


def test_ngram_join_against_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x", "k") for d, t in docs], "doc_id long, text string, key string, h1 string")
    check(chosen_path.near_duplicates(df).collect(), docs, jaccard_links(docs))
    monkeypatch.setattr(chosen_path, "BUCKET", 4)  # now most buckets are split, and large groups are met in blocks
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    monkeypatch.setattr(chosen_path, "PAIRS", 0)
    check(chosen_path.near_duplicates(df).collect(), docs, jaccard_links(docs))


def test_ngram_join_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = chosen_path.near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    check(found, docs, jaccard_links(docs))


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert chosen_path.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (None, "a b c d e f"), (3, None)]
    found = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert found == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (2, 2, 0), (3, 3, 0)]


def test_ngram_join_compares_all_texts_of_an_id(spark):
    words = [[f"{c}{k}" for k in range(40)] for c in "abc"]
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(1, " ".join(w)) for w in words] + [(k + 2, near(w, 39)) for k, w in enumerate(words)] + [(2, near(words[1], 0))]
    found = sorted((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 2, 1), (2, 1, 2, 2), (3, 1, 3, 2), (4, 1, 4, 1)]


def test_shingles_match_words():
    for text in ("a b c d e f g", "A-b, c d e!", "é ü x y z w", "one", "", None, "w " * 5000):
        w = words_of(text)
        k = min(5, len(w))
        assert len(shingles(text)) == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ())
    assert set(shingles("a b c d e f")) & set(shingles("zz b c d e f")) == set(shingles("b c d e f"))


def test_runs_reach_the_recall():
    assert chosen_path.runs_needed(0.8, 0.999) > chosen_path.runs_needed(0.8, 0.9) >= 1


def test_runs_follow_the_depth():
    """The chance to find a pair, by a plain simulation of the splits, is what the number of runs is reckoned from."""
    rng, similarity, levels = np.random.default_rng(3), 0.8, 4
    share, met = 1 / (similarity * chosen_path.POSITIONS), 0
    for _ in range(4000):
        agree = rng.random(chosen_path.POSITIONS) < similarity
        buckets = 1
        for _ in range(levels):
            below = 0
            for _ in range(buckets):
                drawn = np.flatnonzero(rng.random(chosen_path.POSITIONS) < share)
                below += agree[drawn if len(drawn) else [rng.integers(chosen_path.POSITIONS)]].sum()
            buckets = int(below)
        met += buckets > 0
    expected = (chosen_path.agreements(similarity) * (1 - chosen_path.missed(similarity, levels))).sum()
    assert abs(met / 4000 - expected) < 0.03
    needed = [chosen_path.runs_needed(0.8, 0.999, k) for k in (1, 3, 6, 12)]
    assert needed == sorted(needed) and needed[0] < needed[-1]


def test_ngram_join_splits_boilerplate(spark, monkeypatch):
    """Texts that share half of their words stand in large buckets until they are split deep enough."""
    monkeypatch.setattr(chosen_path, "BUCKET", 4)
    monkeypatch.setattr(chosen_path, "PAIRS", 0)
    depths, search = [], chosen_path._search

    def watched(*args):
        out = search(*args)
        depths.append(out[1])
        return out

    monkeypatch.setattr(chosen_path, "_search", watched)
    random.seed(8)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for k in range(120):
        words = [*shared, *(f"w{random.randrange(10**6)}" for _ in range(60))]
        docs.append((2 * k, " ".join(words)))
        if k % 10 == 0:
            words[90] = "changed"
            docs.append((2 * k + 1, " ".join(words)))
    check(chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, jaccard_links(docs))
    assert max(depths) > 3


def test_recall_by_similarity(spark):
    """Every pair of a corpus with boilerplate, by bands of similarity from the threshold on."""
    random.seed(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    boiler = [[random.choice(vocabulary) for _ in range(40)] for _ in range(5)]
    docs, bands = [], defaultdict(list)
    for k in range(1200):
        words = [*random.choice(boiler), *(random.choice(vocabulary) for _ in range(100))]
        docs.append((2 * k, " ".join(words)))
        near = list(words)
        for _ in range(random.randint(1, 4)):
            near[random.randrange(len(near))] = "other"
        docs.append((2 * k + 1, " ".join(near)))
    sets = {d: set(shingles(t).tolist()) for d, t in docs}
    found = {r.doc_id: r.class_id for r in chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k in range(1200):
        a, b = sets[2 * k], sets[2 * k + 1]
        j = len(a & b) / len(a | b)
        if j >= 0.8:
            bands[min(int((j - 0.8) * 20), 2)].append(found[2 * k] == found[2 * k + 1])
    assert all(len(band) >= 100 and np.mean(band) >= 0.995 for band in bands.values()) and len(bands) == 3


def test_sieve_lets_members_pass(spark):
    rows = spark.range(20_000).withColumn("key", F.xxhash64("id"))
    members = rows.where("id % 10 = 0")
    sieve = Sieve(members, F.col("key"), 2000)
    passed, refused = ({r.id for r in f(rows, F.col("key")).collect()} for f in (sieve.passed, sieve.refused))
    assert {k for k in range(20_000) if k % 10 == 0} <= passed and len(passed) < 2600
    assert passed.isdisjoint(refused) and len(passed) + len(refused) == 20_000
    assert Sieve(members.limit(0), F.col("key"), 0).passed(rows, F.col("key")).count() == 0


def test_components(spark):
    random.seed(1)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def vectors(n=1500, width=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, width))
    rows = []
    for k in range(n):
        v = centres[rng.integers(60)] + rng.standard_normal(width) * 0.22
        rows.append((k, int(rng.integers(3)), [float(x) for x in v]))
    rows += [(k, 1, [1.0] + [0.0] * (width - 1)) for k in range(2000, 2400)]
    bad = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] * width, [1.0, 0.0]]
    return rows + [(3000 + k, 1, v) for k, v in enumerate(bad)] + [(3100, None, [1.0] + [0.0] * (width - 1)), (None, 1, [1.0] + [0.0] * (width - 1))]


def vector_links(rows, least=0.93):
    groups = defaultdict(list)
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[label, len(v)].append((i, v))
    out = []
    for own in groups.values():
        x = np.array([v for _, v in own], float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        out += [(own[p][0], own[q][0]) for p, q in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)))]
    return out


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, key string")
    links = vector_links(rows)
    found = {r.vec_id: r for r in projection_forest.near_vectors(df, leaf=64).collect()}
    assert len(found) == len(rows)
    assert len(links) > 0
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert all(r.n_links == count[i] for i, r in found.items() if i is not None)
    want = roots([r[0] for r in rows if r[0] is not None], links)
    assert all(found[i].component_id == c for i, c in want.items())
    assert found[None].n_links == 0 and not found[None].kept and found[2000].n_links == 399
    assert all(found[3000 + k].n_links == 0 for k in range(6))


def test_vectors_lose_no_link_in_deep_trees(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y *= math.sqrt(1 - 0.931**2) / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(k, 1, v) for k, v in enumerate([*x.tolist(), *(0.931 * x + y).tolist()])]  # k and k + 1500 have a cosine of 0.931
    links, count = vector_links(rows), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = projection_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), leaf=4).collect()
    assert len(links) >= 1500 and {r.vec_id: r.n_links for r in found} == {r[0]: count[r[0]] for r in rows}
    assert {r.vec_id: r.component_id for r in found} == roots([r[0] for r in rows], links)


def test_trees_are_recursive_and_their_own(spark):
    """Every size gets eight trees of two levels or more; a child splits what its parent holds; nodes and trees split differently."""
    for rows in (1, 3, 50, 1000, 20_000, 1_000_000, 50_000_000):
        trees, levels, children, margin = projection_forest.plan(0.93, rows, 0.9999, projection_forest.LEAF)
        assert trees >= 8 and levels >= 2 and children <= 16
        lost = next(x for m, x, _ in projection_forest._splits(0.93, children) if m == margin)
        assert (1 - (1 - lost) ** levels) ** trees <= 1e-4
    unit = projection_forest.unit_rows(np.random.default_rng(1).standard_normal((2000, 64)))
    nested = [projection_forest.leaves(unit, 3, levels, 4, 0.0)[1].reshape(3, 2000) - np.arange(3)[:, None] * 4**levels for levels in (1, 2, 3)]
    assert (nested[2] // 4 == nested[1]).all() and (nested[1] // 4 == nested[0]).all() and len(np.unique(nested[2])) > 50
    pairs = lambda *cells: sum((np.logical_and.reduce([c[:, None] == c[None] for c in cells])).ravel()) - 2000  # noqa: E731  (without a vector and itself)
    same = lambda a, b: pairs(a, b) / pairs(a)
    assert all(same(nested[2][a], nested[2][b]) < 0.05 for a, b in ((0, 1), (0, 2), (1, 2)))  # what one tree holds together, others part
    signs = projection_forest.node_signs(0, 1, np.arange(4), 64)
    assert all(10 < (signs[a] != signs[b]).sum() < 54 for a, b in itertools.combinations(range(4), 2))
    assert projection_forest.node_signs(2, 3, np.arange(5), 100).shape == (5, 100)


@pytest.mark.parametrize("n, spread", [(500, 0.35), (20_000, 0.3)])
def test_vectors_of_one_label_lose_no_link(spark, n, spread):
    """Brute force over a whole label, small and large: no link is lost, none is added."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    half = n // 5
    x[half : 2 * half] = x[:half] + spread * rng.standard_normal((half, 64)).astype(np.float32)  # cosines around the threshold
    rows = [(k, 1, v) for k, v in enumerate(x.tolist())]
    links, count = vector_links(rows), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = projection_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert len(links) > 0.05 * n and {r.vec_id: r.n_links for r in found} == {r[0]: count[r[0]] for r in rows}
    assert {r.vec_id: r.component_id for r in found} == roots([r[0] for r in rows], links)


def test_vectors_need_little_disk(spark, monkeypatch, tmp_path):
    """What stands on disk at once is a small multiple of the vectors, though each is in many leaves."""
    monkeypatch.setattr(projection_forest, "PASS", 1, raising=False)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x[10_000:12_000] = x[:2000] + 0.2 * rng.standard_normal((2000, 64)).astype(np.float32)
    rows = [(k, 1, v) for k, v in enumerate(x.tolist())]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/in")
    links, count = vector_links(rows), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    folders = [f.getPath() for f in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    folders.append(shared_dir(spark).removeprefix("file:"))

    def used():
        total = 0
        for folder in folders:
            for at, _, names in os.walk(folder):
                for name in names:
                    with contextlib.suppress(OSError):  # a file may go meanwhile
                        total += os.path.getsize(f"{at}/{name}")
        return total

    before, peak, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            peak[0] = max(peak[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = {r.vec_id: r.n_links for r in projection_forest.near_vectors(spark.read.parquet(f"{tmp_path}/in"), leaf=16).collect()}
    finally:
        over.set()
        watcher.join()
    assert len(links) >= 1500 and found == {r[0]: count[r[0]] for r in rows}
    assert 0 < peak[0] <= 4 * x.nbytes


@pytest.mark.parametrize("blocked", [50_000, 0])
def test_vectors_in_passes_and_blocks(spark, monkeypatch, blocked):
    """Each pair counts once, in whatever pass and pair of blocks of its leaves it is met."""
    monkeypatch.setattr(projection_forest, "PASS", 1)
    monkeypatch.setattr(projection_forest, "BLOCK", 20)
    monkeypatch.setattr(projection_forest, "BLOCKED", blocked)
    rows = vectors(n=1990, seed=6)
    links, count = vector_links(rows), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r.vec_id: r for r in projection_forest.near_vectors(df, leaf=64).collect()}
    assert {i: r.n_links for i, r in found.items()} == {r[0]: count[r[0]] for r in rows}
    want = roots([r[0] for r in rows if r[0] is not None], links)
    assert all(found[i].component_id == c for i, c in want.items())


def test_vectors_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert projection_forest.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [1.0, 0.0])]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in projection_forest.near_vectors(spark.createDataFrame(rows, schema)).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
