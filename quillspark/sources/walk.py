"""A Spark data source over a directory tree: sorted, complete, and never through links; read whole, or as it grows."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, ord array<string>, kind string, size long, link string, utf8 boolean"
#: Names and endings that are never sources (fixed values).
NOISE_NAMES, NOISE_ENDINGS = (".DS_Store",), ("-wal", "-shm", ".tmp")


def is_noise(name: str) -> bool:
    return name in NOISE_NAMES or name.endswith(NOISE_ENDINGS)


def walk(root: str, below: str = "", noise: bool = False) -> Iterator[tuple[str, list[str], str, int, str | None, bool]]:
    """Entries under ``below``, in each directory by name: files, links and special files, not directories."""
    with os.scandir(os.path.join(root, below) if below else root) as found:
        entries = sorted((e for e in found if noise or not is_noise(e.name)), key=lambda e: os.fsencode(e.name))
    for e in entries:
        path = f"{below}/{e.name}" if below else e.name
        if e.is_dir(follow_symlinks=False):
            yield from walk(root, path, noise)
            continue
        yield entry(root, path)


def entry(root: str, path: str) -> tuple[str, list[str], str, int, str | None, bool]:
    full = os.path.join(root, path)
    utf8 = not any("\udc80" <= c <= "\udcff" for c in path)
    shown = path if utf8 else path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if os.path.islink(full):
        return shown, shown.split("/"), "symlink", 0, os.readlink(full), utf8
    if os.path.isfile(full):
        return shown, shown.split("/"), "file", os.lstat(full).st_size, None, utf8
    return shown, shown.split("/"), "other", 0, None, utf8


class _Subtree(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Tree:
    """What both readers share: the options, and how names are split into parts and read."""

    def __init__(self, options: dict[str, str]):
        self.root, self.parts, self.noise = options["root"], int(options.get("partitions", "64")), options.get("noise") == "true"
        if os.path.islink(self.root) or not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is a link or no directory")

    def parted(self, names: list[str]) -> list[InputPartition]:
        """Entries in walk order, with folders opened level by level until there are several for each part."""
        opened = 0
        while len(names) < 4 * self.parts and opened < self.parts:
            folders = [k for k, n in enumerate(names) if self._is_folder(n)]
            if not folders:
                break
            below = {k: self._listed(names[k]) for k in folders[: self.parts]}
            opened += len(below)
            names = [n for k, name in enumerate(names) for n in (below[k] if k in below else [name])]
        step = max(1, -(-len(names) // self.parts))
        return [_Subtree(names[k : k + step]) for k in range(0, len(names), step)] or [_Subtree([])]

    def _listed(self, below: str) -> list[str]:
        found = os.listdir(os.path.join(self.root, below) if below else self.root)
        return [f"{below}/{n}" if below else n for n in sorted((n for n in found if self.noise or not is_noise(n)), key=os.fsencode)]

    def _is_folder(self, name: str) -> bool:
        full = os.path.join(self.root, name)
        return os.path.isdir(full) and not os.path.islink(full)

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for name in partition.names:
            if self._is_folder(name):
                yield from walk(self.root, name, self.noise)
            else:
                yield entry(self.root, name)


class _Reader(_Tree, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.parted(self._listed(""))


class _Arrivals(_Tree, DataSourceStreamReader):
    """What has arrived at the root's top since an offset: the time of the last change there, and the names that bear it.

    The unit of arrival is an entry of the top folder, a file or a folder that is moved in when it is complete. Only the
    top folder is listed to find them; folders are walked by executors, and those only that arrived. A file that is
    replaced, or a folder whose own entries change, arrives again; a change deeper inside an old folder is not seen.
    Entries younger than ``settle`` seconds wait for the next batch, since the clock may give its time to others yet.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.settle = float(options.get("settle", "2"))

    def initialOffset(self) -> dict:
        return {"time": 0, "names": []}

    def latestOffset(self) -> dict:
        ready = time.time_ns() - int(self.settle * 1e9)
        found = [(t, n) for t, n in self._top() if t <= ready]
        last = max((t for t, _ in found), default=0)
        return {"time": last, "names": sorted(n for t, n in found if t == last)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = set(start["names"])
        new = [n for t, n in self._top() if (t > start["time"] or t == start["time"] and n not in known) and (t < end["time"] or t == end["time"] and n in end["names"])]
        return self.parted(sorted(new, key=os.fsencode))

    def _top(self) -> list[tuple[int, str]]:
        top = []
        for name in self._listed(""):
            try:
                top.append((os.lstat(os.path.join(self.root, name)).st_ctime_ns, name))
            except FileNotFoundError:
                pass  # taken away since it was listed
        return top


class TreeSource(DataSource):
    """``spark.read.format("tree").option("root", path)``, or ``readStream``; the root must be visible to all executors.

    Option noise "true" keeps the names that are never sources; settle is for streams (:class:`_Arrivals`).
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Arrivals(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
