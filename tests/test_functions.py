"""Scalar functions against plain models and known answers."""

import unicodedata
from collections.abc import Iterator

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.converters.archive import listed_name, member_path
from quillspark.functions import hashing
from quillspark.functions import text as T
from quillspark.operators import tree_hash
from quillspark.plans.folders import Kept


def rows(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_blake3_known_answers():
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert hashing.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(pattern(1)) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert hashing.blake3(pattern(1025)).startswith("d00278ae47eb27b34faecf67b4fe263f")
    many = [pattern(n) for n in (0, 1, 64, 1023, 1024, 1025, 3072, 5000, 99_999)]
    assert hashing.blake3_many(many) == [hashing.blake3(m) for m in many]


def test_blake3_of_files_in_pieces(spark, tmp_path):
    """Files around the edges of chunks, pieces and groups, hashed by pieces in many tasks."""
    sizes = (0, 1, 1024, 2048, 2049, 4096, 7 * 1024, 8 * 1024, 8 * 1024 + 1, 33_333, 64 * 1024, 64 * 1024 + 5)
    for n in sizes:
        (tmp_path / f"f{n}").write_bytes(bytes(i % 251 for i in range(n)))
    files = spark.createDataFrame([(f"f{n}", n) for n in sizes], "path string, size long")
    want = {f"f{n}": hashing.blake3((tmp_path / f"f{n}").read_bytes()) for n in sizes}
    for piece, group in ((1024, 2), (1024, 8), (2048, 4), (8192, 1024)):
        assert {r.path: r.hash for r in tree_hash.file_hashes(files, str(tmp_path), piece, group).collect()} == want


def test_blake3_of_streams(spark, tmp_path):
    """Rows of a key one behind the other: empty and null ones, rows longer than a piece, pieces of many rows, a null key."""
    sizes = [0, 1, 5000, 3, 0, 1024, 1020, 4, 9000, 700, 2]
    held = [(key, k, None if n == 3 else bytearray((k * 7 + i) % 253 for i in range(n))) for key in ("a", None) for k, n in enumerate(sizes)] + [("none", 0, None), ("one", 0, bytearray(b"x" * 1024))]
    df = spark.createDataFrame(held, "key string, at int, body binary").repartition(3)
    found = tree_hash.stream_hashes(df, ["key"], ["at"], "body", Kept(spark, str(tmp_path)).store, 1024, 4)
    want = {key: b"".join(bytes(b) for k, _, b in sorted((h for h in held if h[0] == key), key=lambda h: h[1]) if b is not None) for key in ("a", None, "none", "one")}
    assert {r.key: (r.bytes, r.hash) for r in found.collect()} == {k: (len(v), hashing.blake3(v)) for k, v in want.items()}


def test_streams_move_no_pieces_by_key(spark, tmp_path):
    """What meets the sizes of a stream is its pieces' values, not their bytes, which would bring a whole stream into one task."""
    kept, plans = Kept(spark, str(tmp_path)), {}

    def store(frame, name):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return kept.store(frame, name)

    bodies = [("whole", 0, b"a" * 1024), ("two", 0, b"b" * 1024), ("two", 1, b"c" * 1024), ("short", 0, b"d"), ("none", 0, None), ("five", 0, b"e" * 4097), (None, 0, b"f" * 1025)]
    df = spark.createDataFrame(bodies, "key string, at int, body binary")
    found = {r.key: r.hash for r in tree_hash.stream_hashes(df, ["key"], ["at"], "body", store, 1024, 2).collect()}
    assert found == {k: hashing.blake3(b"".join(b or b"" for key, _, b in bodies if key == k)) for k in {key for key, _, _ in bodies}}
    assert "hashed(" in plans["stream-pieces"] and "collect_list" in plans["stream-pieces"]
    assert "bytes#" not in plans["stream-pieces"]



def test_normalize_text(spark):
    assert rows(spark, ["a\r\nb\rc", "é", "ﬁ", None], T.normalize_text) == ["a\nb\nc", "é", "ﬁ", None]


def test_nfc_of_plain_texts_stays_on_the_jvm(spark, monkeypatch):
    """Texts without a character from U+0300 on are in the form already; no others reach Python."""
    assert all(unicodedata.is_normalized("NFC", chr(c)) for c in range(0x300))
    texts = ["plain", "é ÿ ˿", "e\u0301", "\u0300", "\u212b", "", None, "a\nb\u00e9", "\U0001d15e"]
    assert rows(spark, texts, T.nfc) == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]

    def refuse(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            assert values.isna().all()
            yield values

    monkeypatch.setattr(T, "_nfc", refuse)
    assert rows(spark, ["plain", "é ÿ ˿", None, ""], T.nfc) == ["plain", "é ÿ ˿", None, ""]


def test_member_paths(spark):
    names = ["a/b", "a\\b", "/a", "\\a", "C:x", "a//b", "./a", "a/../b", "", "a\nb", "ü/x"]
    assert rows(spark, names, T.safe_member) == [member_path(n) for n in names] == ["a/b", "a/b", None, None, None, None, None, None, None, None, "ü/x"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12))
def test_safe_paths_never_climb(name):
    safe = member_path(name)
    assert safe is None or not ({"", ".", ".."} & set(safe.split("/")) or any(unicodedata.category(c) == "Cc" for c in safe))
    assert "\n" not in listed_name(name) and "\t" not in listed_name(name)


def test_cells_and_names(spark):
    assert rows(spark, ["a\tb\nc\rd"], T.escape_cell) == ["a\\tb\\nc\\rd"]
    assert rows(spark, ["a\tb\nc"], T.flatten_cell) == ["a b c"]
    assert rows(spark, ["x/y/..n.txt. ", " . ", None], T.attachment_name) == ["n.txt", "unnamed", "unnamed"]
    assert rows(spark, ["a/b.TXT", ".env", "x.tar.gz", "plain", "d.x/plain"], T.extension) == ["txt", None, "gz", None, None]


def test_times_lengths_and_positions(spark):
    seconds = spark.createDataFrame([(0.0,), (3661.9,), (-1.0,), (float("inf"),), (360000.0,)], "v double")
    assert [r[0] for r in seconds.select(T.timecode(F.col("v"))).collect()] == ["00:00:00", "01:01:01", None, None, "100:00:00"]
    assert rows(spark, ["10", "1in", "72pt", "-3px", "5em"], T.css_pixels) == [10.0, 96.0, 96.0, None, None]
    assert rows(spark, ["A1", "XFD1048576", "XFE1", "a1"], T.cell_position) == [(0, 0), (1_048_575, 16_383), None, None]


def test_gates(spark):
    assert rows(spark, ["x", " ​﻿\n", ""], T.has_meaning) == [True, False, False]
    assert rows(spark, ["aé\0b", "ab"], T.nul_at) == [3, None]
    assert rows(spark, ["d/a.txt", "a", "d/../a", "d/a:b"], T.is_recorded_path) == [True, False, False, False]
