"""Cells of any type as text: a schema is compiled to one expression, so nested values are rendered on the JVM, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _shorter(parts: Column, size: Column, kind: str) -> Column:
    """digits and point with one digit less, if that still reads back as the same number."""
    digits, point, n = parts["digits"], parts["point"], F.length(parts["digits"])
    step = F.concat(F.lit("1E"), (point - (n - 1)).cast("string")).try_cast("double")
    # a last digit of 5 may stand for less: remainders by powers of ten are exact where these are doubles
    below = (F.substring(digits, n, F.lit(1)) == "5") & point.between(n, n + 21) & ((size.cast("double") % step) * 2 < step)
    rounded = (digits.try_cast("long") + F.when(below, 0).otherwise(5)).cast("string")  # no digits: null

    def judged(f: Column) -> Column:
        scale = point - (n - 1)
        same = F.concat(f, F.lit("E"), scale.cast("string")).try_cast(kind) == size
        return F.when((n > 1) & same, F.struct(F.rtrim(f, F.lit("0")).alias("digits"), (scale + F.length(f)).alias("point"))).otherwise(parts)

    return let(F.substring(rounded, F.lit(1), F.length(rounded) - 1), judged)


def _settled(parts: Column, size: Column, own: Column) -> Column:
    """digits and point of a float, or ``own``, those of its double, where the fewest digits leave a choice: the float lies midway
    between two such texts, or the text midway between two floats.

    Floats of the first kind are whole multiples of 2**-14, those of the second are 2**24 or more, and whole too.
    """
    wide, n = size.cast("double"), F.length(parts["digits"])
    beside = F.concat(parts["digits"], F.lit("E"), (parts["point"] - n).cast("string")).try_cast("double") * 2 - wide
    edge = (wide >= 1 << 24) & (beside != wide) & (beside.cast("float").cast("double") == beside)
    midway = lambda d: (F.length(d["digits"]) == n + 1) & F.endswith(d["digits"], F.lit("5"))
    return F.when((wide * (1 << 14)) % 1 == 0, let(own, lambda d: F.when(edge | midway(d), d).otherwise(parts))).otherwise(parts)


def positional(value: Column, kind: str, settled: bool = False) -> Column:
    """A float or double by the fewest digits that read back as it, without exponent or needless fraction; NaN, inf and -inf.

    The digits come from the platform's own text, from which up to two needless ones are taken. They always read back as the
    number; beyond 1e22 the last of 17 may be another than that of the nearest such text. ``settled``: a float whose fewest
    digits leave a choice is shown as its double is.
    """
    size = F.abs(value)

    def parsed(s: Column) -> Column:
        mantissa, exponent = F.split_part(s, F.lit("E"), F.lit(1)), F.coalesce(F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        whole, fraction = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        return let(F.concat(whole, fraction), lambda d: let(F.ltrim(d, F.lit("0")), lambda k: F.struct(F.rtrim(k, F.lit("0")).alias("digits"), (F.length(whole) + exponent - F.length(d) + F.length(k)).alias("point"))))

    def plain(p: Column) -> Column:
        digits, point, n = p["digits"], p["point"], F.length(p["digits"])
        return (
            F.when(n == 0, F.lit("0"))
            .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )

    def fewest(size: Column, kind: str) -> Column:
        return let(let(parsed(size.cast("string")), lambda p: _shorter(p, size, kind)), lambda p: _shorter(p, size, kind))

    digits = fewest(size, kind)
    if settled and kind == "float":
        digits = let(digits, lambda p: _settled(p, size, fewest(size.cast("double"), "double")))
    shown = let(digits, plain)
    sign = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    endless = size == F.lit(float("inf"))
    return F.when(F.isnan(value), "NaN").when(endless, F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, shown))


def cell(value: Column, kind: T.DataType, settled: bool = False) -> Column:
    """A value as a cell: lists ``[a, b]``, maps ``{key: value}`` with their entries sorted, structs ``{name: value}``, at any depth.

    Null is empty, inside others too; bytes are hex digits in lower case; dates and times are their days and microseconds
    since 1970; text stays as it is (a row's renderer escapes it). ``settled``: see ``positional``.
    """
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: cell(e, kind.elementType, settled)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(cell(e["key"], kind.keyType, settled), F.lit(": "), cell(e["value"], kind.valueType, settled)))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(entries), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}: "), cell(value.getField(f.name), f.dataType, settled)) for f in kind.fields]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = positional(value, kind.simpleString(), settled)
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(value))
    elif isinstance(kind, T.DateType):
        text = F.unix_date(value).cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, T.TimestampNTZType):
        minutes = (F.unix_date(value.cast("date")).cast("long") * 24 + F.hour(value)) * 60 + F.minute(value)
        text = (minutes * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")).cast("string")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def cells(schema: T.StructType, settled: bool = False) -> list[Column]:
    """Each column of a frame as text, under its own name; ``settled``: see ``positional``."""
    return [cell(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType, settled).alias(f.name) for f in schema.fields]
