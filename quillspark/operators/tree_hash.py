"""BLAKE3 of streams of any size, by many tasks: pieces are hashed where they are, their values merged up the tree.

A stream is cut into pieces of a power of two of bytes. A whole piece is a complete subtree, so neighbours' values are merged
in groups of a power of two, and those in groups again; a group holds a few kilobytes, and no task or driver sees a stream.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import merged_chains, piece_chain
from quillspark.operators.scan import Scan, Store

#: Bytes of a piece, and neighbours merged at once; powers of two.
PIECE, GROUP = 1 << 20, 1 << 10


def merged(chains: DataFrame, keys: list[str], most: int, group: int = GROUP) -> DataFrame:
    """(keys, hash) from the values of pieces; chains: keys, at (from 0), pieces (of the stream, ``most`` at most), chain."""

    @F.pandas_udf("binary")
    def merge(parts: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series(merged_chains([[bytes(p["chain"]) for p in x] for x in parts], last.tolist()), dtype=object)

    rows = chains
    while most > 1:
        parts = F.array_sort(F.collect_list(F.struct("at", "chain"))).alias("parts")  # at most ``group``
        many = rows.where("pieces > 1").groupBy(*keys, F.floor(F.col("at") / group).alias("at"), F.ceil(F.col("pieces") / group).alias("pieces")).agg(parts)
        up = many.select(*keys, "at", "pieces", merge("parts", F.col("pieces") == 1).alias("chain"))
        rows = rows.where("pieces = 1").select(*keys, "at", "pieces", "chain").unionByName(up)
        most = -(-most // group)
    return rows.select(*keys, F.lower(F.hex("chain")).alias("hash"))


def stream_hashes(rows: DataFrame, keys: list[str], order: list[str], content: str, store: Store, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """(keys, bytes, hash): the BLAKE3 hash of all contents of a key, one behind the other in order; null contents are empty."""
    bare = rows.select(*keys, *order, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("_body"))
    scan = Scan(bare, keys, order, store, "stream").sum("_end", F.octet_length("_body").cast("long")).rows
    placed = scan.withColumn("_begin", F.col("_end") - F.octet_length("_body"))
    total = store(placed.groupBy(*keys).agg(F.max("_end").alias("bytes")), "stream-sizes")
    full = placed.where("_end > _begin").withColumn("at", F.explode(F.sequence(F.expr(f"_begin div {piece}"), F.expr(f"(_end - 1) div {piece}"))))
    first = F.greatest(F.col("at") * piece, F.col("_begin"))
    part = F.substring("_body", (first - F.col("_begin") + 1).cast("int"), (F.least((F.col("at") + 1) * piece, F.col("_end")) - first).cast("int"))
    pieces = full.select(*keys, "at", F.struct(first.alias("first"), part.alias("part")).alias("piece")).groupBy(*keys, "at").agg(F.array_sort(F.collect_list("piece")).alias("parts"))  # ``piece`` bytes at most

    @F.pandas_udf("chain binary, alone binary")
    def hashed(parts: pd.Series, at: pd.Series) -> pd.DataFrame:
        """A piece's value, and its hash if it may be the only one: a first piece that isn't full surely is, a full one may be."""
        out = []
        for x, a in zip(parts, at):
            data = b"".join(bytes(p["part"]) for p in x)
            first = int(a) == 0
            out.append([None if first and len(data) < piece else piece_chain(data, int(a), piece, False), piece_chain(data, 0, piece, True) if first else None])
        return pd.DataFrame(out, columns=["chain", "alone"])

    key = lambda df: df.withColumn("_key", F.struct(*keys)).drop(*keys)  # noqa: E731  (null keys are equal in a struct)
    # pieces are hashed where they were put together; only their values, 64 bytes at most, meet the sizes by stream
    values = store(key(pieces.select(*keys, "at", hashed("parts", "at").alias("value")).select(*keys, "at", "value.*")), "stream-pieces")
    empty = F.lit(piece_chain(b"", 0, piece, True))
    count = F.greatest(F.ceil(F.col("bytes") / piece), F.lit(1)).alias("pieces")
    met = key(total).join(values, "_key", "left").select("_key", F.coalesce("at", F.lit(0).cast("long")).alias("at"), count, "chain", "alone")
    chains = met.withColumn("chain", F.when(F.col("pieces") > 1, F.col("chain")).otherwise(F.coalesce("alone", empty))).drop("alone")
    most = -(-(total.agg(F.max("bytes")).first()[0] or 1) // piece) or 1
    return merged(chains, ["_key"], most, group).join(key(total), "_key").select("_key.*", "bytes", "hash")


def file_hashes(files: DataFrame, root: str, piece: int = 8 * PIECE, group: int = GROUP) -> DataFrame:
    """(path, hash) of files below a root that all machines see; files: path, size. A large file is read by many tasks."""
    count = F.greatest(F.expr(f"cast(ceil(size / {piece}) as long)"), F.lit(1).cast("long"))
    pieces = files.select("path", count.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, n, at in batch.itertuples(index=False, name=None):
                with open(os.path.join(root, path), "rb") as file:
                    file.seek(at * piece)
                    out.append([path, at, n, piece_chain(file.read(piece), at, piece, n == 1)])
            yield pd.DataFrame(out, columns=["path", "at", "pieces", "chain"])

    dealt = pieces.repartition("path", "at")  # else the pieces of a file stay in the task that lists them
    most = files.agg(F.max(count)).first()[0] or 1
    return merged(dealt.mapInPandas(run, "path string, at long, pieces long, chain binary"), ["path"], most, group)


