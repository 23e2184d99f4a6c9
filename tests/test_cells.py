"""Cells of any type against plain Python."""

import datetime
import struct

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.converters.records import number
from quillspark.functions.cells import cell, cells
from quillspark.plans.queries import _plain_sql

NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 2e-3, 1e-7, 123456789.125, 1e15, 1e22, 5e-324, 2.0**-44, 6.102007803125512e18, 6.387333013218292e17, 99.5, 1e300, float("inf"), float("-inf"), float("nan"), None]


def shown(spark, values, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("k", T.LongType()), T.StructField("v", kind)]))
    return [r[0] for r in df.orderBy("k").select(cell(F.col("v"), kind)).collect()]


def test_numbers(spark):
    assert shown(spark, NUMBERS, T.DoubleType()) == ["" if x is None else number(x) for x in NUMBERS]
    assert shown(spark, [0.1, 1e10, 1.2015328e10, 1.1754944e-38, 16777216.0], T.FloatType()) == ["0.1", "10000000000", "12015328000", "0.000000000000000000000000000000000000011754944", "16777216"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=200, max_size=400), st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=200, max_size=400))
def test_numbers_read_back(spark, doubles, floats):
    assert [float(s) for s in shown(spark, doubles, T.DoubleType())] == doubles
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    assert [single(float(s)) for s in shown(spark, floats, T.FloatType())] == floats
    assert [s for s in shown(spark, [x for x in doubles if abs(x) < 1e15], T.DoubleType())] == [number(x) for x in doubles if abs(x) < 1e15]


def test_settled_floats(spark):
    """Floats midway between two shortest texts, and those whose shortest text is midway between two floats, as DuckDB shows them."""
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    floats = [0.0185546875, -0.0185546875, 0.1, 33571368.0, 16777216.0, 0.0, 5e-7, 1.1754944e-38]
    floats += [float(m) / 2**j for j in range(15) for m in range(1, 1 << 24, 397_211)] + [float(single(x)) for x in range(2**24, 2**33, 40_000_003)]
    con = duckdb.connect()
    con.execute("CREATE TABLE f (k INT, x FLOAT)")
    con.executemany("INSERT INTO f VALUES (?, ?)", list(enumerate(floats)))
    df = spark.createDataFrame(list(enumerate(floats)), "k int, v float").repartition(2)
    got = [r[0] for r in df.orderBy("k").select(cell(F.col("v"), T.FloatType(), settled=True)).collect()]
    assert got == [r[0] for r in con.execute(f"SELECT {_plain_sql('x')} FROM f ORDER BY k").fetchall()]
    assert got[:4] == ["0.0185546875", "-0.0185546875", "0.1", "33571368"]
    assert shown(spark, [0.0185546875], T.FloatType()) == ["0.018554688"]
    vector = spark.createDataFrame([([0.0185546875, None],)], "e array<float>")
    assert vector.select(*cells(vector.schema, settled=True)).first()[0] == "[0.0185546875, ]"


def test_nested(spark):
    inner = T.StructType([T.StructField("a b", T.ArrayType(T.IntegerType())), T.StructField("m", T.MapType(T.StringType(), T.BinaryType()))])
    rows = [([1, None, 3], {"z": b"\x00\xff", "a": None, "Z": b""}), ([], {}), (None, None), None]
    assert shown(spark, rows, inner) == ["{a b: [1, , 3], m: {Z: , a: , z: 00ff}}", "{a b: [], m: {}}", "{a b: , m: }", ""]
    deep = T.ArrayType(T.ArrayType(T.StructType([T.StructField("t", T.StringType())])))
    assert shown(spark, [[[("x\ty",), (None,), None], [], None]], deep) == ["[[{t: x\ty}, {t: }, ], [], ]"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moment = datetime.datetime(2024, 3, 10, 2, 30, 0, 123456)  # an hour that New York lacked
        micros = (moment - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        assert shown(spark, [moment, datetime.datetime(1969, 12, 31, 23, 59, 59, 5)], T.TimestampNTZType()) == [str(micros), "-999995"]
        assert shown(spark, [datetime.date(1970, 1, 3), datetime.date(1969, 12, 31)], T.DateType()) == ["2", "-1"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_names_of_columns(spark):
    df = spark.createDataFrame([(1, True)], "`a.b` int, `c``d` boolean")
    assert df.select(*cells(df.schema)).collect()[0].asDict() == {"a.b": "1", "c`d": "true"}
