"""Periodic runs against a plain search over all periods and starts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA

from quillspark.llm import periodic_runs
from quillspark.llm.queries import QUERIES


def plain_runs(words):
    """Every maximal stretch with period q, for each q, kept if q is its smallest period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            if length >= max(6, 4 * q) and not any(q % d == 0 and part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(k):
    a, b = [0], [0, 1]
    for _ in range(k):
        a, b = b, b + a
    return b


def cases():
    random.seed(11)
    yield from ([0] * n for n in range(9))
    yield from ([0, 1] * n for n in range(2, 6))
    yield [0] * 300
    yield fibonacci(11)
    yield (fibonacci(8) * 5)[:-3]
    for m, t in ((5, 6), (16, 5), (31, 4), (32, 5), (33, 4)):
        yield ([0] * m + [1]) * t
        yield [7, 8] + ([0] * m + [1] + [0] * (m // 2) + [2]) * t + [9, 7]
    yield ([0, 1] * 6 + [2]) * 9 + [0, 1] * 20 + ([0, 1] * 6 + [2]) * 5
    for _ in range(400):
        letters = random.choice((1, 2, 2, 3, 8))
        words = []
        while len(words) < random.choice((20, 60, 150)):
            unit = [random.randrange(letters) for _ in range(random.choice((1, 2, 3, 5, 7, 8, 9, 15, 16, 17)))]
            words += (unit * random.randint(1, 7))[: random.randint(1, 90)]
        yield words


def test_runs_against_all_periods():
    total = 0
    for words in cases():
        found = [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64)).tolist()]
        assert found == plain_runs(words), words
        total += len(found)
    assert total > 500


def test_long_texts_with_one_word_or_nested_periods():
    """Long and highly periodic texts take no more than linear numbers of seeds a scale."""
    n = 200_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    nested = np.array(([0] * 999 + [1]) * 200, np.int64)
    found = periodic_runs.runs_of(nested).tolist()
    assert [0, n, 1000] in found and len(found) == 201
    rng = np.random.default_rng(3)
    tail = np.tile(rng.integers(0, 50_000, 30_000), 5)
    assert periodic_runs.runs_of(np.concatenate([rng.integers(0, 50_000, 50_000), tail])).tolist()[-1][1:] == [150_000, 30_000]


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = plant(doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def digests(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string")
    text = periodic_runs.planted(df.doc_id, df.text)
    return rows_of(periodic_runs.digests(periodic_runs.find_runs(df.withColumn("text", text))))


def test_digests_of_odd_texts(spark):
    """Nulls, empty and blank texts, all kinds of spaces, repeated rows, ties of exponents, a clashing column."""
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a " * 10), (5, "a\x0bb\x0ca\x1cb  "), (6, "é " * 6 + "b " * 6), (6, "é " * 6 + "b " * 6), (7, "x y " * 3), (8, "x y " * 4)]
    rows += [(10 + k, " ".join(f"w{j % (7 + k)}" for j in range(60))) for k in range(60)]  # ids among them get a planted end
    assert digests(spark, rows) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert digests(spark, []) == []


def test_very_long_words_and_texts(spark):
    rows = [(1, "a" * 300_000), (2, "b " * 100_000), (3, " ".join(str(k % 5003) for k in range(40_000)))]
    found = {r[0]: r for r in digests(spark, rows)}
    assert found[1][1] == 0 and found[2][1:6] == (1, 0, 100_000, 1, 100_000_000) and found[3][1:5] == (1, 0, 40_000, 5003)


@pytest.mark.parametrize("name", ["op12_periodic_runs"])
def test_query(spark, name):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert rows_of(QUERIES[name](spark, DATA)) == sorted((plain_row(r.doc_id, r.text) for r in table.collect()), key=str)
