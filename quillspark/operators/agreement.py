"""Whether two extractions of one source agree: token Dice and length ratio."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the verdict.
LENGTH_AGREES, DICE_AGREES, LENGTH_FAILS = 0.90, 0.95, 0.50
#: Unicode white space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{WHITE}]+")


def comparable(text: str) -> str:
    """NFC, white space runs as one space, trimmed, case kept."""
    return _RUNS.sub(" ", unicodedata.normalize("NFC", text)).strip(" ")


def metrics(left: str, right: str) -> tuple[float, int, int]:
    """Dice of the token multisets of two comparable texts (1 if both are empty), and their lengths in bytes."""
    a, b = left.split(" ") if left else [], right.split(" ") if right else []
    counts = Counter(a)
    shared = sum(min(n, counts[t]) for t, n in Counter(b).items() if t in counts)
    return (2 * shared / (len(a) + len(b)) if a or b else 1.0), len(left.encode()), len(right.encode())


def _measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in parts:
        yield pd.DataFrame([metrics(comparable(a or ""), comparable(b or "")) for a, b in zip(left, right)], columns=["dice", "la", "lb"])


def agreement(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, dice, length_ratio and verdict of two texts per row, computed where the row is; null texts are empty."""
    both = F.pandas_udf(_measured, "dice double, la long, lb long")(F.col(left), F.col(right))
    found = pairs.select(key, both.alias("m")).select(key, "m.*")
    ratio = F.when(F.greatest("la", "lb") == 0, 1.0).otherwise(F.least("la", "lb") / F.greatest("la", "lb"))
    return found.select(key, "dice", ratio.alias("length_ratio"), verdict(F.col("dice"), ratio, F.col("la"), F.col("lb")).alias("verdict"))


def verdict(dice: Column, ratio: Column, primary: Column, secondary: Column) -> Column:
    return F.when((ratio >= LENGTH_AGREES) & (dice >= DICE_AGREES), "agreement").when(primary < LENGTH_FAILS * secondary, "failure").otherwise("divergence")


def judged(primary: str, secondary: str) -> tuple[str, float, float]:
    """The verdict of two texts, their length ratio and Dice, as :func:`agreement` has them."""
    dice, la, lb = metrics(comparable(primary), comparable(secondary))
    ratio = min(la, lb) / max(la, lb) if la or lb else 1.0
    if ratio >= LENGTH_AGREES and dice >= DICE_AGREES:
        return "agreement", ratio, dice
    return ("failure" if la < LENGTH_FAILS * lb else "divergence"), ratio, dice
