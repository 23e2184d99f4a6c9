"""What several operators share: table reading, durable cuts of lineage, word splitting and hashing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that end a word; letters fold to lower case, everything from 0x80 on belongs to words.
_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or on one machine alone a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_ROOTS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the application ends is deleted then."""
    root = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # noqa: BLE001  (the JVM may be gone already)
        pass


class Scratch:
    """Tables kept while an operator works, and deleted at its end; what leaves it must not read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(scratch(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet in the shared folder and read again, so that later steps survive lost executors."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` stored beyond this scratch, all of whose own tables are deleted."""
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.clear()
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark deletes the shuffle files of each query as soon as the query has ended.

    Else they stay until the driver happens to collect its garbage. What is read again must be stored.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or that with underscores behind it where a column has it already."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def apart(key: Column) -> Column:
    """A long key that the planner takes for a new one.

    A join with an aggregate by that key then gets exchanges of its own, whose large partitions adaptive execution can
    split; else it would share the aggregate's, which it can't.
    """
    return F.bitwise_not(F.bitwise_not(key))


#: Bits of a sieve, at most: a table of 32 MB.
SIEVE_BITS = 1 << 28


class Sieve:
    """A filter that says of a hash that it may be a member's, or surely is none.

    It is a bitmap in rows of 4 KB, broadcast, with about 64 bits for a member but never more than ``SIEVE_BITS``: with
    more members more rows pass that needn't, so the join behind it works alike at every size.
    """

    def __init__(self, members: DataFrame, key: Column, count: int):
        self.bits = min(SIEVE_BITS, max(1 << 15, 1 << (64 * count).bit_length()))
        at = members.select(F.pmod(key, F.lit(self.bits)).alias("at"))
        self.table = at.groupBy(F.expr("at div 32768").alias("_part")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("_map"))

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows that may be members."""
        return self._met(rows, key).where(F.coalesce(self._bit(), F.lit(0)) == 1).drop("_at", "_part", "_map")

    def refused(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows that surely are none."""
        return self._met(rows, key).where(F.coalesce(self._bit(), F.lit(0)) == 0).drop("_at", "_part", "_map")

    def _met(self, rows: DataFrame, key: Column) -> DataFrame:
        placed = rows.withColumn("_at", F.pmod(key, F.lit(self.bits)))
        return placed.join(F.broadcast(self.table), F.expr("_at div 32768") == F.col("_part"), "left")

    @staticmethod
    def _bit() -> Column:
        byte = F.expr("cast(conv(hex(substring(_map, cast(_at % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
        return F.getbit(byte, F.expr("cast(_at % 8 as int)"))


def fold_crc(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, as the folds use it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 14)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    A text of fewer words, but not none, has one shingle of all its words; a text without words has none.
    Substring hashes come from one prefix sum over the bytes, so the cost is linear and needs no per-word calls.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.append(np.flatnonzero(joined == 32), len(joined))
    starts = np.append(0, ends[:-1] + 1)
    width = min(width, len(words))
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    up, down = _powers(len(joined) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=np.uint64)])
        hashes = mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.unique(hashes)
