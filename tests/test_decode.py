"""Decoding on the JVM against Python's decoders, whole and broken."""

import random

from pyspark.sql import functions as F

from quillspark.converters.base import ConvertError, decode
from quillspark.functions.decode import decoded


def plain(data):
    try:
        text, warnings = decode(data)
        return text, warnings[0] if warnings else None, None
    except ConvertError as e:
        return None, None, str(e)


def samples():
    random.seed(9)
    texts = ["", "a", "plain", "é", "日本語" * 20, "😀x😀", "\x00", "a퟿z", "x" * 5000 + "é"]
    for t in texts:
        yield t.encode()
        yield b"\xef\xbb\xbf" + t.encode()
        for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
            yield mark + t.encode(name)
            yield mark + t.encode(name) + b"\x41"
            for unit in (0xD800, 0xDBFF, 0xDC00, 0xDFFF):
                lone = unit.to_bytes(2, "little" if name.endswith("le") else "big")
                yield mark + lone + t.encode(name)
                yield mark + t.encode(name) + lone
                yield mark + t.encode(name) + lone + "zz".encode(name)
                yield mark + t.encode(name) + lone * 2 + "z".encode(name)
        for bad in (b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80\x80\x80", b"\x80"):
            yield t.encode() + bad
            yield t.encode() + bad + "é tail".encode()
            yield b"\xef\xbb\xbf" + t.encode() + bad
    yield from (b"\xff\xfe\x00\x00a", b"\x00\x00\xfe\xff", b"\xff\xfe", b"\xfe\xff", b"\xef\xbb", b"\xef\xbb\xbf\xef\xbb\xbf", b"\xff", b"\xfe\xff\xd8", b"\x1d\x8a\x00\x00")
    for _ in range(1500):
        yield bytes(random.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0xED, 0xA0, 0xD8, 0xDC, 0xFE, 0xFF, 0x00]) for _ in range(random.randint(0, 12)))


def test_decoded_as_python_does(spark):
    rows = [(k, bytearray(b)) for k, b in enumerate(samples())]
    df = spark.createDataFrame([*rows, (-1, None)], "id int, data binary").select("id", decoded(F.col("data")).alias("d")).select("id", "d.*")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    found = {r.id: (r.text, r.warning, r.error) for r in df.collect()}
    assert found.pop(-1) == (None, None, None)
    for k, b in rows:
        assert found[k] == plain(bytes(b)), bytes(b)
