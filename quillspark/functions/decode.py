"""Text sources decoded by their byte order marks on the JVM: every branch is guarded, so no malformed byte reaches a decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte order marks (fixed values).
UTF8_MARK, UTF16_MARKS, UTF32_MARKS = b"\xef\xbb\xbf", {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}, (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")


def _valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def first_invalid(data: Column) -> Column:
    """Where the first sequence begins that is no UTF-8; for bytes that have one.

    The bytes before a place are fine, but for three at most that may begin a character, just if the place isn't more than
    three behind the one looked for; so it is found by halving.
    """
    upto = lambda n: _valid(F.substring(data, F.lit(1), n.cast("int")))
    near = lambda n: [n - k for k in range(4)]

    def able(n: Column) -> Column:
        found = F.lit(False)
        for k in near(n):
            found = found | ((k >= 0) & upto(k))
        return found

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("long")
        good = able(middle)
        return F.struct(F.when(good, middle).otherwise(state["low"]).alias("low"), F.when(good, state["high"]).otherwise(middle - 1).alias("high"))

    start = F.struct(F.lit(0).cast("long").alias("low"), F.octet_length(data).cast("long").alias("high"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda state: state["low"])
    held = F.transform(F.array(last), lambda n: F.coalesce(*(F.when((k >= 0) & upto(k), k) for k in near(n))))
    return F.element_at(held, 1)


def lone_surrogate(units: Column) -> Column:
    """How many bytes stand before the first unpaired surrogate, or null; units: UTF-16 in big-endian order as hex digits."""
    told = F.regexp_replace(units, "(D[89AB]..D[C-F]..)|(....)", "$1$2 ")  # pairs stay together, all others stand alone
    at = F.regexp_instr(told, F.lit("(?<![0-9A-F])D[89A-F][0-9A-F]{2} "))
    before = F.length(F.replace(F.substring(told, F.lit(1), at - 1), F.lit(" "), F.lit("")))
    return F.when(at > 0, (before / 2).cast("long"))


def decoded(data: Column) -> Column:
    """(text, warning, error) of a source's bytes: one of text and error is null; null bytes give nulls.

    UTF-32 is refused, UTF-16 transcoded, all else must be UTF-8; places in errors count the mark.
    """
    size = F.octet_length(data)
    none = F.lit(None).cast("string")
    told = lambda text, warning, error: F.struct(text.alias("text"), warning.alias("warning"), error.alias("error"))
    out = F.when(data.isNull(), told(none, none, none)).when(F.substring(data, 1, 4).isin(*UTF32_MARKS), told(none, none, F.lit("unsupported-encoding: UTF-32")))
    for name, mark in UTF16_MARKS.items():
        body = F.substring(data, F.lit(3), F.greatest(size - 2, F.lit(0)))
        units = F.hex(body) if name == "utf-16be" else F.regexp_replace(F.hex(body), "(..)(..)", "$2$1")
        lone = lone_surrogate(units)
        mine = F.when(size % 2 == 1, told(none, none, F.concat(F.lit("invalid_utf16: odd byte at "), size - 1)))
        mine = mine.when(lone.isNotNull(), told(none, none, F.concat(F.lit("invalid_utf16: unpaired surrogate at byte "), lone + 2)))
        mine = mine.otherwise(told(F.decode(body, name.upper()), F.lit(f"transcoded from {name}"), none))
        out = out.when(F.substring(data, 1, 2) == F.lit(mark), mine)
    out = out.when(~_valid(data), told(none, none, F.concat(F.lit("invalid_utf8: invalid UTF-8 at byte "), first_invalid(data))))
    bare = F.substring(data, F.lit(4), size).cast("string")
    return out.when(F.substring(data, 1, 3) == F.lit(UTF8_MARK), told(bare, F.lit("stripped leading byte order mark"), none)).otherwise(told(data.cast("string"), none, none))
