"""Scalar transforms as columns. What Catalyst has no function for is an Arrow-batched UDF."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.sources import walk

#: Format characters that show nothing (fixed values).
INVISIBLE = r"\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"


def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Only texts with a character from U+0300 on, below which all are in that form, go to Python."""
    own = F.rlike(text, F.lit("[^\\x{0}-\\x{2FF}]"))
    return F.when(own, F.pandas_udf(_nfc, "string")(F.when(own, text))).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Line ends to LF, then NFC; never NFKC."""
    return nfc(F.regexp_replace(text, "\r\n?", "\n"))


def is_noise(name: Column) -> Column:
    """Whether a file name is never a source."""
    return name.isin(*walk.NOISE_NAMES) | F.exists(F.array(*map(F.lit, walk.NOISE_ENDINGS)), lambda e: F.endswith(name, e))


#: Names of divisions and runs (fixed values).
DIVISION, RUN_ID = "[A-Za-z0-9_-]+", "[A-Za-z0-9][A-Za-z0-9._-]{0,63}"


def is_division(name: Column) -> Column:
    return name.rlike(rf"\A{DIVISION}\z")


def is_run_id(name: Column) -> Column:
    return name.rlike(rf"\A{RUN_ID}\z")


def mirror_path(division: Column, source_path: Column) -> Column:
    return F.concat(division, F.lit("/"), source_path, F.lit(".txt"))


def segments_path(source_path: Column) -> Column:
    return F.concat(source_path, F.lit(".segments.jsonl"))


def is_recorded_path(path: Column) -> Column:
    """Two segments or more, none empty, ``.`` or ``..``, none with a backslash or colon."""
    parts = F.split(path, "/")
    good = F.forall(parts, lambda p: ~p.isin("", ".", "..") & ~F.contains(p, F.lit("\\")) & ~F.contains(p, F.lit(":")))
    return (F.size(parts) >= 2) & good


def extension(path: Column) -> Column:
    """The lower-cased ASCII extension of the last path segment; null if there is none. A leading dot starts none."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(found != "", F.translate(found, string.ascii_uppercase, string.ascii_lowercase))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def escape_cell(text: Column) -> Column:
    """A record cell on one line: tab, newline and carriage return as two characters each."""
    return F.replace(F.replace(F.replace(nfc(text), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def flatten_cell(text: Column) -> Column:
    """A workbook cell on one line: tab and newline as spaces."""
    return F.translate(nfc(text), "\n\t", "  ")


def collapse_spaces(text: Column) -> Column:
    """Runs of ASCII white space become one space; non-breaking spaces stay."""
    return F.regexp_replace(text, "[ \t\n\r\f]+", " ")


def comparable(text: Column) -> Column:
    """NFC, any Unicode white space run as one space, trimmed, case kept."""
    return F.trim(F.regexp_replace(nfc(text), r"(?U)\s+", " "))


def timecode(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; null for negative or non-finite times."""
    whole = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(whole / 3600)
    shown = F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60))
    return F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf")), shown)


def single_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\r\n", "  "))


def run_collision_key(path: Column) -> Column:
    """NFC and full lower case."""
    return F.lower(nfc(path))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bundle_collision_key(path: Column) -> Column:
    """NFC and ASCII lower case."""
    return ascii_lower(nfc(path))


def safe_member(name: Column) -> Column:
    """The forward-slash relative path of an archive member, or null if its name is unsafe."""
    parts = F.split(name, r"[/\\]")
    bad = (name == "") | name.rlike(r"[\x00-\x1F\x7F-\x{9F}]") | name.rlike(r"^[/\\]") | name.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(~bad, F.array_join(parts, "/"))


def attachment_name(name: Column) -> Column:
    """The last path component without controls, spaces and dots at its ends; ``unnamed`` if nothing is left."""
    last = F.element_at(F.split(name, r"[/\\]"), -1)
    bare = F.regexp_replace(last, r"[\x00-\x1F\x7F-\x{9F}]", "")
    kept = F.btrim(F.trim(bare), F.lit("."))
    return F.when(F.coalesce(kept, F.lit("")) == "", "unnamed").otherwise(kept)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def css_pixels(length: Column) -> Column:
    """A CSS length in px, or null if its unit is unknown or it is not above zero."""
    number = F.regexp_extract(F.trim(length), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z%]*)$", 1)
    unit = F.lower(F.regexp_extract(F.trim(length), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z%]*)$", 2))
    scale = (
        F.when(unit.isin("", "px"), 1.0).when(unit == "pt", 96 / 72).when(unit == "pc", 16.0).when(unit == "in", 96.0)
        .when(unit == "cm", 96 / 2.54).when(unit == "mm", 96 / 25.4).when(unit == "q", 96 / 101.6)
    )
    pixels = F.when(number != "", number).cast("double") * scale
    return F.when((pixels > 0) & (pixels < float("inf")), pixels)


def cell_position(reference: Column) -> Column:
    """(row, col) from 0 of an A1 reference inside 1 048 576 rows and 16 384 columns, or null."""
    letters, digits = F.regexp_extract(reference, r"^([A-Z]{1,3})([1-9][0-9]{0,6})$", 1), F.regexp_extract(reference, r"^([A-Z]{1,3})([1-9][0-9]{0,6})$", 2)
    col = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
    row = F.when(digits != "", digits).cast("int")
    good = (row <= 1_048_576) & (col >= 1) & (col <= 16_384)
    return F.when(good, F.struct((row - 1).alias("row"), (col - 1).alias("col")))


def formula_cell(value: Column, formula: Column) -> Column:
    """``value [=formula]``, either alone if the other is missing."""
    inert = F.concat(F.lit("[="), formula, F.lit("]"))
    return F.when(formula.isNull(), F.coalesce(value, F.lit(""))).when(F.coalesce(value, F.lit("")) == "", inert).otherwise(F.concat(value, F.lit(" "), inert))


def has_meaning(text: Column) -> Column:
    """Whether any character is neither white space nor a control nor invisible."""
    return text.rlike(rf"(?U)[^\s\p{{Cc}}{INVISIBLE}]")


def nul_at(text: Column) -> Column:
    """The byte offset of the first NUL, or null."""
    at = F.instr(text, F.chr(F.lit(0)))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def output_gate(text: Column, size: Column, most: int) -> Column:
    """Why a text made from a source of ``size`` bytes isn't fit to be written, cheapest first, or null."""
    return (
        F.when(F.octet_length(text) > most, "resource_limit").when(nul_at(text).isNotNull(), "nul_bytes").when((size > 0) & (text == ""), "empty_output").when(~has_meaning(text), "no_text")
    )


def collapse_blank_lines(text: Column) -> Column:
    """Runs of empty lines become one, and none leads."""
    return F.regexp_replace(F.regexp_replace(text, "\n\n+", "\n\n"), r"\A\n+", "")
