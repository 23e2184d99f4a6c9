"""scan, run, status and explain over a directory tree.

The tree, the mirror and the manifest stand on storage that driver and executors share. Content is read twice at most:
once to hash and detect, and once more to convert what neither the manifest nor another source has.
"""

from __future__ import annotations

import errno
import functools
import os
import re
import shutil
import stat
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.converters import archive, hooks, images, registry, vector
from quillspark.converters.base import ConvertError, Outcome, gate, sidecar, sidecar_problem
from quillspark.functions.hashing import blake3
from quillspark.functions.text import DIVISION
from quillspark.operators import manifest, outcomes
from quillspark.plans import formats
from quillspark.plans.folders import Kept
from quillspark.sources import shard, walk
from quillspark.sources.index import Index
from quillspark.sources.mirror import SCHEMA as SINK_ROWS
from quillspark.sources.mirror import Transaction
from quillspark.sources.shard import RECORD, RECORD_FIELDS


class Refused(ValueError):
    """A run's layout or names are not allowed; nothing was written."""


def check_names(root: str, mirror: str, manifest_dir: str, division: str) -> None:
    if not re.fullmatch(DIVISION, division):
        raise Refused(f"division {division!r}")
    real = os.path.realpath
    for out in (mirror, manifest_dir):
        a, b = real(root) + "/", real(out) + "/"
        if a.startswith(b) or b.startswith(a):
            raise Refused(f"{out} and {root} must not lie in each other")


def entries(spark: SparkSession, root: str) -> DataFrame:
    walk.register(spark)
    return spark.read.format("tree").option("root", root).load()


_FRONT = "path string, ord array<string>, kind string, source_hash string, source_size long, declared_format string, detected_format string, format_mismatch boolean, warnings array<string>, error string"


def front(found: DataFrame, root: str) -> DataFrame:
    """Hash, size and detection of each entry, from one reading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, order, kind, size, link, utf8 in batch.itertuples(index=False, name=None):
                declared = formats.TABLE.declared(path)
                row = {"path": path, "ord": order, "kind": kind, "source_hash": "", "source_size": size, "declared_format": declared, "detected_format": "unknown", "format_mismatch": False, "warnings": [], "error": None}
                if kind == "symlink":
                    row |= {"detected_format": "symlink", "source_hash": blake3(os.fsencode(link)), "declared_format": None}
                elif not utf8:
                    row |= {"error": "non_utf8_path", "detected_format": declared or "unknown"}
                elif size > formats.MAX_SOURCE:
                    row |= {"error": f"resource_limit: source exceeds {formats.MAX_SOURCE} bytes", "detected_format": declared or "unknown"}
                elif kind == "file":
                    try:
                        with open(os.path.join(root, path), "rb") as file:
                            data = file.read()
                        declared, detected, mismatch, warning = formats.TABLE.resolve(path, formats.magic(data))
                        row |= {"source_hash": blake3(data), "source_size": len(data), "declared_format": declared, "detected_format": detected, "format_mismatch": mismatch, "warnings": [warning] if warning else []}
                    except OSError as e:
                        row |= {"error": f"source_io_error: {e.strerror}", "detected_format": declared or "unknown"}
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FRONT.split(", ")])

    return found.where("kind <> 'other'").mapInPandas(run, _FRONT)


def envelope_intact(mirror: str, text_path: str | None, text_hash: str | None) -> bool:
    """Whether an artifact still has its recorded hash and its sidecar parses and fits it."""
    try:
        with open(os.path.join(mirror, text_path), "rb") as file:
            text = file.read()
        if blake3(text) != text_hash:
            return False
        with open(os.path.join(mirror, text_path.removesuffix(".txt") + ".segments.jsonl"), "rb") as file:
            return sidecar_problem(file.read(), text) is None
    except (OSError, TypeError, AttributeError):
        return False


def prior_records(spark: SparkSession, manifest_dir: str, division: str) -> tuple[DataFrame, list[str]]:
    """The records of a division's shard, and the reader's warnings."""
    path = os.path.join(manifest_dir, f"{division}.jsonl")
    if not os.path.exists(path):
        return spark.createDataFrame([], shard.FRAME), []
    return shard.read(spark, path, division)


#: A unit: a source, a member of a container, or what is found beside one; its record's fields as far as they are known before conversion.
_UNIT = {"root": "array<string>", "nth": "int", "source_path": "string", "kind": "string"} | {
    f: RECORD[f] for f in ("source_hash", "source_size", "declared_format", "detected_format", "format_mismatch", "parent_source", "warnings", "error")
}
#: A unit of a container, with its bytes or its listing.
_INSIDE = _UNIT | {"data": "binary", "text": "binary", "sidecar": "binary", "text_hash": "string", "duration_ms": "long"}
#: What conversion made of a content: ``suffix`` tells a child's outcome from the content's own.
_OUTCOME = {
    "source_hash": "string", "key": "string", "suffix": "string", "text": "binary", "sidecar": "binary", "text_hash": "string", "artifact_kind": "string", "recorded": "string",
    "tool_version": "string", "media": RECORD["media"], "o_warnings": "array<string>", "o_error": "string", "duration_ms": "long",
}
#: Bytes of members in one batch on their way from an expansion, about.
BATCH_BYTES = 8 << 20
#: Errors that are the one source's and not the content's.
OWN_ERRORS = ("source_changed_during_run", "source_io_error")


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def expanded(containers: DataFrame, root: str) -> DataFrame:
    """The units of each container, members first and the container last, with the bytes of members that a task meets first.

    A container's own text, its listing, is made here, since its bytes are at hand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given_out: set[tuple[str, str]] = set()
        rows, size = [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=list(_INSIDE), dtype=object)

        for batch in batches:
            for r in batch.itertuples(index=False):
                began, nth = time.monotonic(), 0
                try:
                    data = read_source(root, r.source_path, r.source_hash)
                except ConvertError as e:
                    rows.append([r.root, 0, r.source_path, "container", r.source_hash, r.source_size, r.declared_format, r.detected_format, r.format_mismatch, None, list(r.warnings), str(e), None, None, None, None, 0])
                    continue
                for unit in archive.Expansion(lambda p: os.path.isdir(os.path.join(root, p)), blake3).run(r.source_path, data):
                    top = unit.path == r.source_path
                    own = [r.source_hash, r.source_size, r.declared_format, r.detected_format, r.format_mismatch, None, list(r.warnings)] if top else member(unit)
                    kind = "container" if own[3] in formats.CONTAINERS else "member"
                    text = side = body = None
                    error = unit.error
                    if error is None and kind == "container":
                        outcome, error = registry.convert(unit.data, own[3])
                        if outcome is not None:
                            text, side = outcome.text.encode(), sidecar(outcome.segments)
                            own[6] = [*own[6], *outcome.warnings]
                    elif error is None and (own[0], own[3]) not in given_out:
                        given_out.add((own[0], own[3]))
                        body = unit.data
                        size += len(body)
                    now = time.monotonic()
                    rows.append([r.root, nth, unit.path, kind, *own, error, body, text, side, None if text is None else blake3(text), int((now - began) * 1000)])
                    began, nth = now, nth + 1
                    size += len(text or b"")
                    if size >= BATCH_BYTES:
                        yield flush()
                        rows, size = [], 0
        yield flush()

    return containers.mapInPandas(run, _ddl(_INSIDE))


def member(unit: archive.Unit) -> list:
    """A member's record fields, from its bytes."""
    body = unit.data or b""
    declared, detected, mismatch, warning = formats.TABLE.resolve(unit.path, formats.magic(body))
    return [blake3(body) if unit.data is not None else "", len(body), declared, detected, mismatch, unit.parent, [warning] if warning else []]


def read_source(root: str, path: str, expected: str) -> bytes:
    """A source's bytes if they still are what was hashed."""
    try:
        with open(os.path.join(root, path), "rb") as file:
            data = file.read()
    except OSError as e:
        raise ConvertError("source_io_error", e.strerror or "") from None
    if blake3(data) != expected:
        raise ConvertError("source_changed_during_run")
    return data


def outcomes_of(data: bytes, fmt: str) -> Iterator[tuple[str, Outcome | None, str | None]]:
    """(suffix, outcome, error) of a content: its own text if its format has a converter, and those of its children."""
    if registry.route(fmt)[0] is not None:
        yield "", *registry.convert(data, fmt)
    for suffix, make in ((".d/#image-ocr", lambda: vector.rasterized(data) if fmt == "svg" and hooks.engine("vector") else None), (".d/#image-metadata", lambda: images.metadata(data, fmt) if fmt in formats.METADATA_FORMATS else None)):
        try:
            found = make()
            if found is not None:
                yield suffix, gate(found), None
        except ConvertError as e:
            yield suffix, None, str(e)


def converted(work: DataFrame, root: str, engines: dict[str, str] | None) -> DataFrame:
    """The outcomes (``_OUTCOME``) of contents; work: source_hash, key, source_path, detected_format, data (null: to be read from the tree)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hooks.install(engines)
        for batch in batches:
            rows, size = [], 0
            for r in batch.itertuples(index=False):
                began = time.monotonic()
                try:
                    data = bytes(r.data) if r.data is not None else read_source(root, r.source_path, r.source_hash)
                    made = outcomes_of(data, r.detected_format)
                except ConvertError as e:
                    made = [("", None, str(e))]
                for suffix, outcome, error in made:
                    now = time.monotonic()
                    took, began = int((now - began) * 1000), now
                    if outcome is None:
                        rows.append([r.source_hash, r.key, suffix, *[None] * 7, [], error, took])
                        continue
                    text = outcome.text.encode()
                    rows.append([r.source_hash, r.key, suffix, text, sidecar(outcome.segments), blake3(text), outcome.artifact_kind, outcome.converter_id, outcome.tool_version, outcome.media, outcome.warnings, None, took])
                    size += len(text)
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=list(_OUTCOME), dtype=object)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=list(_OUTCOME), dtype=object)

    return work.select("source_hash", "key", "source_path", "detected_format", "data").mapInPandas(run, _ddl(_OUTCOME))


def readable(units: DataFrame, root: str) -> DataFrame:
    """source_path and the error of each source whose bytes are not what was hashed any more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, expected in zip(batch.source_path, batch.source_hash):
                try:
                    read_source(root, path, expected)
                    found.append(None)
                except ConvertError as e:
                    found.append(str(e))
            yield pd.DataFrame({"source_path": batch.source_path, "own_error": found}, dtype=object)

    return units.select("source_path", "source_hash").mapInPandas(run, "source_path string, own_error string")


def place_problem(folder: str, path: str) -> str | None:
    """What stands on disk where an artifact, or a folder above it, must be."""
    target = os.path.join(folder, path)
    try:
        above = os.stat(os.path.dirname(target))
    except FileNotFoundError:
        above = None
    except OSError as e:
        return e.strerror
    if above is not None and not stat.S_ISDIR(above.st_mode):
        return os.strerror(errno.ENOTDIR)
    return os.strerror(errno.EISDIR) if any(os.path.isdir(target + end) for end in outcomes.ENDINGS) else None


def placed(units: DataFrame, mirror: str, division: str) -> DataFrame:
    """source_path and what on disk keeps it from being written, where something does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [place_problem(os.path.join(mirror, division), p) for p in batch.source_path]
            yield pd.DataFrame({"source_path": batch.source_path, "on_disk": found}, dtype=object).dropna()

    return units.select("source_path").mapInPandas(run, "source_path string, on_disk string")


def lines_of(records: DataFrame) -> DataFrame:
    """The manifest's lines (value) in the order (ord), by partition."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                own = {f: v for f, v in row.items() if given(v)}
                own["warnings"] = list(own.get("warnings", []))
                own |= {f: int(own[f]) for f in ("source_size", "duration_ms") if f in own}
                own["format_mismatch"] = bool(own["format_mismatch"])
                if "media" in own:
                    own["media"] = {k: v for k, v in dict(own["media"]).items() if given(v)}
                out.append(shard.encode(own).rstrip("\n"))
            yield pd.DataFrame({"value": out})

    return records.orderBy("ord").select(*RECORD_FIELDS).mapInPandas(lines, "value string")


def run(
    spark: SparkSession, root: str, mirror: str, manifest_dir: str, division: str, engines: dict[str, str] | None = None, arrived: DataFrame | None = None, token: str | None = None
) -> dict:
    """Convert what is new or changed, append one record per source and member, and count them.

    Containers are opened first; sources and members are then one set of units. Each content among them is converted once, and
    what each unit gets is settled by its place in the walk. Artifacts and lines are staged, committed and published together:
    a run that fails leaves mirror and manifest as they were, and one that dies after its commit is carried forward by the next.

    engines: for "speech", "recognition" and "vector" the ``module:function`` that workers import (see converters.hooks).
    arrived: the entries (see sources.walk) that the run is about, whole top-level entries of the tree; without it, all. What
    else the manifest knows is neither walked nor hashed, but for those artifacts whose content has arrived again.
    token: names the work; a run whose token was the last to be published has been done before and writes nothing.
    """
    check_names(root, mirror, manifest_dir, division)
    os.makedirs(mirror, exist_ok=True)
    os.makedirs(manifest_dir, exist_ok=True)
    shard_path = os.path.join(manifest_dir, f"{division}.jsonl")
    change = Transaction(spark, mirror, shard_path, division)
    change.recover()
    none_yet = {s: 0 for s in manifest.STATUSES}
    if token is not None and change.published() == token:
        return {"division": division, "special": 0, "records": 0, "counts": none_yet, "warnings": []}
    tables = Kept(spark, os.path.abspath(os.path.join(manifest_dir, f".run-{division}")))  # so that a lost executor costs no conversion
    shutil.rmtree(tables.folder, ignore_errors=True)  # what a run that died has left
    try:
        walked = tables.store(entries(spark, root) if arrived is None else arrived, "walked")
        prior, notes = prior_records(spark, manifest_dir, division)
        artifacts, records = _planned(spark, tables.store, prior, walked, arrived is not None, root, mirror, division, engines)
        counts = none_yet | {r["status"]: r["count"] for r in records.groupBy("status").count().collect()}
        change.stage(artifacts, lines_of(records), token)
        change.publish()
        special = walked.where("kind = 'other'").count()
    finally:
        shutil.rmtree(tables.folder, ignore_errors=True)
    return {"division": division, "special": special, "records": sum(counts.values()), "counts": counts, "warnings": notes}


def within(records: DataFrame, walked: DataFrame) -> DataFrame:
    """The records of top-level entries that were walked, and of the members of those that are containers.

    A folder of the name a container's members have may add its records; nothing is decided by them.
    """
    top = walked.select(F.col("ord")[0].alias("_top")).distinct().select(F.explode(F.array("_top", F.concat("_top", F.lit(".d")))).alias("_top")).distinct()
    return records.withColumn("_top", F.substring_index("source_path", "/", 1)).join(top, "_top", "left_semi").drop("_top")


def _planned(
    spark: SparkSession, store: outcomes.Store, prior: DataFrame, walked: DataFrame, partial: bool, root: str, mirror: str, division: str, engines: dict[str, str] | None
) -> tuple[DataFrame, DataFrame]:
    """(artifacts, records) of a run over the walked entries, which are a part of the tree or all; nothing is written but tables."""
    none = lambda kind: F.lit(None).cast(kind)
    every_last = manifest.terminal(prior)
    if partial:
        every_last = store(every_last, "every-last")
    last = store(within(every_last, walked) if partial else every_last, "last")

    def intact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(intact=[envelope_intact(mirror, p, h) for p, h in zip(batch.text_path, batch.text_hash)])[["source_path", "intact"]]

    bearing = last.where(manifest.has_text(F.col("status")))
    marked = store(bearing.select("source_path", "text_path", "text_hash").mapInPandas(intact, "source_path string, intact boolean"), "intact")
    whole = manifest.whole(marked).withColumnRenamed("intact", "all_intact").join(marked, "source_path", "left")
    versions = F.create_map(*(F.lit(x) for pair in formats.VERSIONS.items() for x in pair))
    routes = formats.route_rules(spark).select(F.col("format").alias("detected_format"), F.col("converter_id").alias("routed"), F.coalesce("reason", F.lit("no-converter")).alias("reason"))

    def judged(units: DataFrame) -> DataFrame:
        """Units with their converter and whether they stand unchanged: same key as the last record, and intact; with all below, if they may have children."""
        known = units.join(F.broadcast(routes), "detected_format", "left").withColumn("converter_version", versions[F.col("routed")]).withColumn("rules_version", F.lit(formats.RULES_VERSION))
        checked = manifest.checkpoint(known, last.select("source_path", "status", "source_hash", "converter_version", "rules_version")).join(whole, "source_path", "left")
        parents = F.col("detected_format").isin(*formats.CONTAINERS, *formats.METADATA_FORMATS)
        stands = F.coalesce(F.when(parents, F.col("all_intact")).otherwise(F.col("intact")), F.lit(False))
        return checked.withColumn("skip", F.col("skip") & stands).drop("intact", "all_intact")

    # what is there: sources, and the units of containers that are new or changed
    found = front(walked, root).select(F.col("ord").alias("root"), F.lit(0).alias("nth"), F.col("path").alias("source_path"), "kind", "source_hash", "source_size", "declared_format", "detected_format", "format_mismatch", none("string").alias("parent_source"), "warnings", "error")
    sources = store(judged(found), "sources")
    opened = ~F.col("skip") & F.col("detected_format").isin(*formats.CONTAINERS) & F.col("error").isNull() & (F.col("kind") == "file")
    inside = store(expanded(sources.where(opened).select(*_UNIT), root), "members")
    members = judged(inside.select(*_UNIT))
    members = members.withColumn("skip", F.col("skip") & (F.col("kind") == "member") & F.col("error").isNull() & ~F.col("detected_format").isin(*formats.METADATA_FORMATS))
    units = store(sources.where(~F.coalesce(opened, F.lit(False))).unionByName(members).withColumn("ord", outcomes.order_of(F.col("root"), F.col("nth"))), "units")
    fresh = units.where("not skip")

    # each content once: contents with an intact artifact of the same converter are read from it
    plain = F.col("error").isNull() & F.col("kind").isin("file", "member")
    leaves = fresh.where(plain & (F.col("routed").isNotNull() | F.col("detected_format").isin(*formats.METADATA_FORMATS)))
    leaves = leaves.withColumn("key", F.when(F.col("detected_format").isin(*formats.METADATA_FORMATS, "svg"), F.col("detected_format")).otherwise(F.col("routed")))
    if partial:  # of all other artifacts, those are looked at that hold a content which has arrived
        rest = every_last.where(manifest.has_text(F.col("status"))).join(last, "source_path", "left_anti")
        rest = store(rest.join(leaves.select("source_hash").distinct(), "source_hash", "left_semi").select(*bearing.columns), "elsewhere")
        also = store(rest.select("source_path", "text_path", "text_hash").mapInPandas(intact, "source_path string, intact boolean"), "intact-elsewhere")
        bearing, marked = bearing.unionByName(rest), marked.unionByName(also)
    sound = bearing.join(marked.where("intact"), "source_path", "left_semi").where((F.col("status") == "converted") | (F.col("status") == "skipped_unchanged") & F.col("dedup_of").isNull())
    sound = sound.where((F.col("rules_version") == formats.RULES_VERSION) & (F.col("converter_version") == versions[F.col("converter_id")]))
    # not those that this run writes anew or retires: their artifacts will be others
    below = manifest.descendants(sound.where("parent_source is not null"), sources.where(opened)).select("source_path")
    replaced = fresh.select("source_path").unionByName(below).join(units.where("skip").select("source_path"), "source_path", "left_anti").distinct()
    sound = sound.join(replaced, "source_path", "left_anti")
    sound = sound.join(F.broadcast(routes.select("detected_format", F.col("routed").alias("converter_id"))), ["detected_format", "converter_id"], "left_semi")
    seeds = store(sound.select("source_hash", "source_path", F.col("converter_id").alias("converter"), *(f"text_{x}" for x in ("path", "hash")), "artifact_kind", "media", "tool_version", "warnings"), "seeds")
    held = outcomes.carriers(seeds.withColumn("ord", F.col("source_path")), "source_hash")
    kept = held.select("source_hash", F.col("converter").alias("key"), F.lit("").alias("suffix"), none("binary").alias("text"), none("binary").alias("sidecar"), "text_hash", "artifact_kind", F.col("converter").alias("recorded"), "tool_version", "media", F.col("warnings").alias("o_warnings"), none("string").alias("o_error"), F.lit(0).cast("long").alias("duration_ms"), "text_path")
    bytes_of = inside.where("data is not null").select("source_path", "data")
    todo = leaves.join(held.select("source_hash", F.col("converter").alias("key")), ["source_hash", "key"], "left_anti").select("source_hash", "key", "source_path", "ord", "kind", "detected_format")
    first = outcomes.carriers(todo, "source_hash", "key")
    mine = first.where("kind = 'file'").withColumn("data", none("binary"))
    # of a member's content, any member whose bytes an expansion has given out will do: they are the same
    given_out = outcomes.carriers(todo.where("kind = 'member'").join(bytes_of.select("source_path"), "source_path", "left_semi"), "source_hash", "key")
    taken_out = first.where("kind = 'member'").select("source_hash", "key").join(given_out, ["source_hash", "key"]).join(bytes_of, "source_path")
    work = mine.select("source_hash", "key", "source_path", "detected_format", "data").unionByName(taken_out.select("source_hash", "key", "source_path", "detected_format", "data"))
    made = store(converted(work, root, engines), "outcomes")
    own_error = F.coalesce(F.substring_index("o_error", ":", 1).isin(*OWN_ERRORS), F.lit(False))
    failing = store(made.where(own_error).select("source_hash", "key"), "unread-contents")
    unread = spark.createDataFrame([], "source_path string, own_error string")
    if not failing.isEmpty():  # a content whose first source can't be read any more is read from another that can
        again = todo.join(failing, ["source_hash", "key"], "left_semi")
        seen = store(readable(again.where("kind = 'file'"), root), "read-again")
        unread = seen.where("own_error is not null")
        able = again.join(unread, "source_path", "left_anti")
        other = outcomes.carriers(able.join(bytes_of, "source_path", "left").where("kind = 'file' or data is not null"), "source_hash", "key")
        more = store(converted(other.select("source_hash", "key", "source_path", "detected_format", "data"), root, engines), "outcomes-again")
        made = made.where(~own_error).unionByName(more)
    every = made.withColumn("text_path", none("string")).unionByName(kept)

    # what each unit gets
    facts = every.drop("text", "sidecar", "text_path")
    leaf = leaves.join(unread, "source_path", "left").join(facts.where("suffix = ''").drop("suffix"), ["source_hash", "key"], "left")
    leaf = leaf.withColumn("o_error", F.coalesce("own_error", "o_error")).withColumn("recorded", F.when(F.col("own_error").isNull(), F.col("recorded"))).drop("own_error")
    child = outcomes.children(leaves.where(F.col("key") == F.col("detected_format")), facts.where("suffix <> ''"))
    place_of = F.when(F.col("suffix") == ".d/#image-ocr", 1).otherwise(2)  # behind the parent
    child = child.withColumns({"nth": F.col("nth") * 3 + place_of, "kind": F.lit("child"), "declared_format": none("string"), "format_mismatch": F.lit(False), "warnings": F.expr("cast(array() as array<string>)"), "error": none("string")})
    boxes = fresh.where("kind = 'container'").select(*_UNIT).join(inside.where("kind = 'container'").select("source_path", F.col("text").isNotNull().alias("listed"), "duration_ms", "text_hash"), "source_path")
    boxes = boxes.select(*_UNIT, F.lit("box").alias("suffix"), none("string").alias("key"), "text_hash", F.lit("text").alias("artifact_kind"), F.when(F.col("listed"), F.when(F.col("detected_format") == "eml", "eml-mime").otherwise("container-zip")).alias("recorded"), none("string").alias("tool_version"), none(RECORD["media"]).alias("media"), F.expr("cast(array() as array<string>)").alias("o_warnings"), F.col("error").alias("o_error"), "duration_ms")
    rest = ["suffix", "key", "text_hash", "artifact_kind", "recorded", "tool_version", "media", "o_warnings", "o_error", "duration_ms"]
    leaf = leaf.withColumn("suffix", F.lit("")).select(*_UNIT, *rest)
    # a unit's place is tripled to make room for its children
    wide = leaf.unionByName(boxes).withColumn("nth", F.col("nth") * 3).unionByName(child.select(*_UNIT, *rest))
    bodies = store(wide.withColumn("ord", outcomes.order_of(F.col("root"), F.col("nth"))), "bodies")
    writable = bodies.where("recorded is not null").select("source_path", "ord")
    standing = units.where("skip").select("source_path", outcomes.order_of(F.expr("cast(array() as array<string>)"), F.lit(0)).alias("ord"))
    lost = outcomes.blocked(writable.unionByName(standing), store).withColumn("blocked", F.lit(os.strerror(errno.ENOTDIR)))
    barred = placed(writable, mirror, division)
    judged_bodies = bodies.join(lost, "source_path", "left").join(barred, "source_path", "left").withColumn("taken", F.coalesce("blocked", "on_disk")).drop("blocked", "on_disk")
    judged_bodies = store(judged_bodies, "places")
    shared = F.col("suffix") == ""
    settled = judged_bodies.where(shared).join(F.broadcast(routes.select("detected_format", F.col("routed").alias("converter"))), "detected_format", "left")
    seeded = seeds.select("source_hash", "source_path", "converter")
    dealt = outcomes.assigned(settled.where("converter is not null"), seeded, store)
    alone = judged_bodies.where(~shared).withColumn("converter", none("string")).withColumn("dedup_of", none("string")).withColumn("status", F.when(F.col("recorded").isNotNull() & F.col("taken").isNull(), "converted").otherwise("failed"))
    unrouted = settled.where("converter is null").withColumn("dedup_of", none("string")).withColumn("status", F.lit("unsupported"))
    by = F.coalesce("recorded", "converter")  # of a failure too
    text_bearing = F.col("status").isin("converted", "dedup")
    extra = F.array_union("warnings", F.coalesce("o_warnings", F.expr("cast(array() as array<string>)")))
    reasons = F.create_map(*(F.lit(x) for i, _, c, r in formats.all_formats() if c is None for x in (i, r or "no-converter")))
    error = F.when(text_bearing, none("string")).when(F.col("status") == "unsupported", F.coalesce(reasons[F.col("detected_format")], F.lit("no-converter")))
    error = error.when(F.col("recorded").isNull(), F.col("o_error")).otherwise(F.concat(F.lit("mirror_write_error: "), F.col("taken")))
    shown = dealt.unionByName(alone).unionByName(unrouted).select(
        "ord", "key", "suffix", "source_path", "source_hash", "source_size", "declared_format", "detected_format", "format_mismatch", "status",
        F.when(text_bearing, F.concat(F.lit(f"{division}/"), "source_path", F.lit(".txt"))).alias("text_path"), F.when(text_bearing, F.col("text_hash")).alias("text_hash"), F.when(text_bearing, F.col("artifact_kind")).alias("artifact_kind"),
        by.alias("converter_id"), versions[by].alias("converter_version"), F.when(F.col("status") == "converted", F.col("tool_version")).alias("tool_version"),
        F.lit(formats.RULES_VERSION).alias("rules_version"), F.when(text_bearing, F.col("media")).alias("media"), "parent_source", "dedup_of", F.when(text_bearing, extra).otherwise(F.col("warnings")).alias("warnings"), error.alias("error"),
        F.when(F.col("dedup_of").isNotNull(), F.lit(0).cast("long")).otherwise(F.coalesce("duration_ms", F.lit(0).cast("long"))).alias("duration_ms"),
    )

    # units without a content of their own to convert: refused, unread, unsupported
    refused = fresh.where(~plain & (F.col("kind") != "container") | plain & F.col("routed").isNull() & ~F.col("detected_format").isin(*formats.METADATA_FORMATS))
    reason = F.coalesce("error", F.when(F.col("kind") == "symlink", F.lit("no-converter")).otherwise(F.coalesce("reason", F.lit("no-converter"))))
    bare = {f: none(k) for f, k in RECORD.items()}
    bare |= {f: F.col(f) for f in ("source_path", "source_hash", "source_size", "declared_format", "detected_format", "format_mismatch", "parent_source", "warnings", "rules_version")}
    bare |= {"status": F.when(F.col("error").isNotNull(), "failed").otherwise("unsupported"), "error": reason, "duration_ms": F.lit(0).cast("long")}
    place = outcomes.order_of(F.col("root"), F.col("nth") * 3)
    refused = refused.select(place.alias("ord"), none("string").alias("key"), none("string").alias("suffix"), *(c.alias(f) for f, c in bare.items()))
    skipped = units.where("skip").select("source_path", "root", "nth").join(last.drop("division", "line_no"), "source_path").withColumns({"status": F.lit("skipped_unchanged"), "duration_ms": F.lit(0).cast("long")})
    skipped = skipped.select(place.alias("ord"), none("string").alias("key"), none("string").alias("suffix"), *RECORD_FIELDS)
    emitted = shown.unionByName(refused).unionByName(skipped)
    emitted = store(emitted.select("ord", "key", "suffix", *RECORD_FIELDS), "emitted")
    gone = manifest.removed_members(last, sources.where(opened).select("source_path"), emitted)
    bare |= {"source_hash": F.lit(""), "source_size": F.lit(0).cast("long"), "detected_format": F.lit("unknown"), "format_mismatch": F.lit(False), "warnings": F.expr("cast(array() as array<string>)"), "rules_version": F.lit(formats.RULES_VERSION), "status": F.col("status"), "error": F.col("error")}
    retired = gone.select(outcomes.order_of(F.split("source_path", "/"), F.lit(0)).alias("ord"), none("string").alias("key"), none("string").alias("suffix"), *(c.alias(f) for f, c in bare.items()))
    records = store(emitted.unionByName(retired), "records")

    # the artifacts: each written source's text, met by content; what bears none any more goes
    written = records.where(F.col("status").isin("converted", "dedup")).select(F.concat(F.lit(f"{division}/"), "source_path").alias("target"), "source_path", "source_hash", F.col("key").alias("k"), F.col("suffix").alias("s"))
    texts = made.where("text is not null").select(F.col("source_hash").alias("h"), F.col("key"), "suffix", "text", "sidecar")
    same = (F.col("source_hash") == F.col("h")) & (F.col("k") == F.col("key")) & (F.col("s") == F.col("suffix"))
    parts = [written.where("s <> 'box'").join(texts, same).select("target", "text", "sidecar")]
    parts.append(written.where("s = 'box'").join(inside.where("text is not null").select("source_path", "text", "sidecar"), "source_path").select("target", "text", "sidecar"))
    old = written.where("s = ''").join(kept.select(F.col("source_hash").alias("h"), F.col("key"), "suffix", "text_path"), same).select("target", "text_path")
    parts.append(borrowed_texts(old, mirror))
    parts.append(records.where(~manifest.has_text(F.col("status"))).select(F.concat(F.lit(f"{division}/"), "source_path").alias("target"), none("binary").alias("text"), none("binary").alias("sidecar")))
    return functools.reduce(DataFrame.unionByName, parts), records


def borrowed_texts(old: DataFrame, mirror: str) -> DataFrame:
    """(target, text, sidecar) of sources whose content an earlier run's artifact holds; old: target, text_path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, source in zip(batch.target, batch.text_path):
                files = []
                for end in outcomes.ENDINGS:
                    with open(os.path.join(mirror, source.removesuffix(".txt") + end), "rb") as file:
                        files.append(file.read())
                yield pd.DataFrame([[target, *files]], columns=["target", "text", "sidecar"])

    return old.mapInPandas(run, SINK_ROWS)


def given(value: object) -> bool:
    """Whether a worker got a value and not a null in one of pandas' forms."""
    return value is not None and not (isinstance(value, float) and value != value)


def scan(spark: SparkSession, root: str) -> dict:
    """Inventory by detected format, totals and size outliers; writes nothing."""
    found = front(entries(spark, root), root).withColumnRenamed("path", "source_path").persist()
    rows = manifest.inventory(found).orderBy("detected_format").collect()  # one row per format
    total = next((r for r in rows if r.detected_format is None), None)
    big = manifest.outliers(found).select("source_path", "source_size")
    out = {
        "formats": {r.detected_format: {"files": r.files, "bytes": r.bytes} for r in rows if r.detected_format is not None},
        "files": total.files if total else 0,
        "bytes": (total.bytes or 0) if total else 0,
        "outliers": [r.asDict() for r in big.toLocalIterator()],
    }
    found.unpersist()
    return out


def _shards(spark: SparkSession, manifest_dir: str) -> DataFrame:
    names = sorted(n.removesuffix(".jsonl") for n in os.listdir(manifest_dir) if n.endswith(".jsonl"))
    out = spark.createDataFrame([], shard.FRAME)
    for n in names:
        out = out.unionByName(prior_records(spark, manifest_dir, n)[0])
    return out


def status(spark: SparkSession, manifest_dir: str) -> list[dict]:
    """Coverage of each division over terminal records."""
    return [r.asDict() for r in manifest.coverage(_shards(spark, manifest_dir)).orderBy("division").collect()]


def explain(spark: SparkSession, manifest_dir: str, source_path: str) -> list[dict]:
    """Every record of one source, oldest first; from the manifest's index, which is brought up to date first."""
    found = Index(spark, manifest_dir).history(F.col("source_path") == source_path).drop("span", "generation")
    rows = [r.asDict(recursive=True) for r in found.collect()]
    for name in sorted(n for n in os.listdir(manifest_dir) if n.endswith(".jsonl")):
        tail = shard.unended(os.path.join(manifest_dir, name))  # a last line without its end counts if it is whole
        record = shard.parsed(tail)[0] if tail else None
        if record is not None and record["source_path"] == source_path:
            rows.append({f: record.get(f) for f in RECORD_FIELDS} | {"line_no": None, "division": name.removesuffix(".jsonl")})
    return sorted(rows, key=lambda r: r["division"])
