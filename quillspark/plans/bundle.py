"""bundle, verify and merge: a mirror packed so that another machine can prove it whole.

Trees are listed and hashed by executors; comparisons are joins. Each step of a verification finds all offenders, and
the first step that finds any refuses. A bundle holds no time, so equal inputs make equal bundles.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bundles, manifest, tree_hash, render
from quillspark.plans import formats
from quillspark.sources import shard, walk

SCHEMA = "quillspark/bundle@1"
RULES_FILE, SUMS_FILE, DESCRIPTOR = "rules.json", "checksums.b3", "BUNDLE.json"
TOP = {"mirror", "manifest", RULES_FILE, SUMS_FILE, DESCRIPTOR}


class Refused(ValueError):
    """A verb found problems and did nothing more."""

    def __init__(self, verb: str, problems: list[str]):
        super().__init__(f"{verb}: " + "; ".join(problems[:20]))
        self.problems = problems


def rules_text() -> str:
    rows = [{"id": i, "extensions": e, "converter": c, "reason": r} for i, e, c, r in formats.all_formats()]
    return json.dumps({"version": formats.RULES_VERSION, "formats": rows, "versions": formats.VERSIONS}, indent=1, sort_keys=True) + "\n"


def tree_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, hash) of everything under a folder; large files are hashed by many tasks."""
    walk.register(spark)
    found = spark.read.format("tree").option("root", root).option("noise", "true").load().select("path", "kind", "size")
    hashed = tree_hash.file_hashes(found.where("kind = 'file'").select("path", "size"), root)
    return found.select("path", "kind").join(hashed, "path", "left")


def file_hash(spark: SparkSession, path: str) -> str:
    """The hash of one file, however large."""
    folder, name = os.path.split(path)
    return tree_hash.file_hashes(spark.createDataFrame([(name, os.path.getsize(path))], "path string, size long"), folder).first().hash


def frame(spark: SparkSession, root: str, divisions: list[str]) -> DataFrame:
    """The records of a bundle's shards, with their order; raises ShardError for the first that isn't whole."""
    out = spark.createDataFrame([], shard.FRAME)
    for division in divisions:
        out = out.unionByName(shard.read(spark, os.path.join(root, "manifest", f"{division}.jsonl"), division, strict=True)[0])
    return out


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """Copy all files under a folder, by executors; links stay links, so that a verification can refuse them."""
    walk.register(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                place = os.path.join(target, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                temporary = f"{place}.{os.getpid()}.{time.monotonic_ns()}.tmp"
                shutil.copyfile(os.path.join(source, path), temporary, follow_symlinks=False)
                os.replace(temporary, place)
            yield batch[["path"]]

    os.makedirs(target, exist_ok=True)
    spark.read.format("tree").option("root", source).option("noise", "true").load().where("kind <> 'other'").select("path").mapInPandas(run, "path string").count()


def _listed(df: DataFrame, column: str = "path", most: int = 1000) -> list[str]:
    """Offenders for a message; the first of them are enough to refuse."""
    return [r[0] for r in df.select(column).orderBy(column).limit(most).collect()]


def counts_of(records: DataFrame) -> tuple[dict, dict]:
    """counts and coverage of each division, as a descriptor has them; one row a division."""
    rows = bundles.counts_and_coverage(records).collect()
    counts = {r["division"]: {k: r[k] for k in (*manifest.STATUSES, "total")} for r in rows}
    return counts, {r["division"]: {"covered": r["covered"], "total": r["sources"]} for r in rows}


def _write_sums(spark: SparkSession, root: str) -> str:
    rows = tree_hashes(spark, root).where(~F.col("path").isin(SUMS_FILE, DESCRIPTOR)).orderBy("path")
    with open(os.path.join(root, SUMS_FILE), "w", encoding="utf-8", newline="\n") as file:
        for r in rows.toLocalIterator():
            file.write(f"{r['hash']}  {r['path']}\n")
    return file_hash(spark, os.path.join(root, SUMS_FILE))


def _describe(spark: SparkSession, root: str, run_ids: list[str], divisions: list[str], counts: dict, coverage: dict) -> dict:
    out = {"schema": SCHEMA, "manifest_schema": shard.SCHEMA, "run_ids": run_ids, "divisions": divisions, "counts": counts, "coverage": coverage, "checksums_hash": _write_sums(spark, root)}
    with open(os.path.join(root, DESCRIPTOR), "w", encoding="utf-8", newline="\n") as file:
        file.write(json.dumps(out, indent=1, ensure_ascii=False) + "\n")
    return out


def _new_folder(verb: str, out: str) -> None:
    if os.path.exists(out) and (not os.path.isdir(out) or os.listdir(out)):
        raise Refused(verb, [f"{out} is not empty"])


def bundle(spark: SparkSession, mirror: str, manifest_dir: str, division: str, out: str) -> dict:
    """Pack one division: its mirror, shard, rules, checksums and descriptor; then verify the result."""
    _new_folder("bundle", out)
    source = os.path.join(manifest_dir, f"{division}.jsonl")
    os.makedirs(os.path.join(out, "manifest"))
    shutil.copyfile(source, os.path.join(out, "manifest", f"{division}.jsonl"))
    try:
        records = frame(spark, out, [division])
    except shard.ShardError as e:
        shutil.rmtree(out)
        raise Refused("bundle", [str(e)]) from None
    last = manifest.terminal(records)
    other = _listed(last.where(manifest.has_text(F.col("status")) & (F.col("rules_version") != formats.RULES_VERSION)), "source_path")
    own = os.path.join(mirror, division)
    found = spark.createDataFrame([], "path string, hash string")
    if os.path.isdir(own):
        listed = spark.read.format("tree").option("root", own).option("noise", "true").load().where("kind = 'file'")
        found = listed.select(F.concat(F.lit(f"{division}/"), "path").alias("path"), F.lit("").alias("hash"))
    absent = _listed(bundles.artifact_states(last, found).where("state = 'missing'"), "text_path")
    if other or absent:
        shutil.rmtree(out)
        raise Refused("bundle", [f"other rules: {p}" for p in other] + [f"no artifact: {p}" for p in absent])
    os.makedirs(os.path.join(out, "mirror", division))
    if os.path.isdir(own):
        copy_tree(spark, own, os.path.join(out, "mirror", division))
    with open(os.path.join(out, RULES_FILE), "w", encoding="utf-8") as file:
        file.write(rules_text())
    described = _describe(spark, out, [file_hash(spark, source)], [division], *counts_of(records))
    verify(spark, out)
    return described


def verify(spark: SparkSession, root: str) -> dict:
    """Seven steps in order; returns the descriptor of a bundle that passes all."""
    # 1: the descriptor
    try:
        with open(os.path.join(root, DESCRIPTOR), encoding="utf-8") as file:
            d = json.load(file)
        problems = [f"unknown field {k}" for k in d.keys() - {"schema", "manifest_schema", "run_ids", "divisions", "counts", "coverage", "checksums_hash"}]
        problems += [f"{k} must rise strictly" for k in ("run_ids", "divisions") if d[k] != sorted(set(d[k])) or not d[k]]
        problems += [f"run id {r!r}" for r in d["run_ids"] if not re.fullmatch(T.RUN_ID, r)]
        problems += [f"division {v!r}" for v in d["divisions"] if not re.fullmatch(T.DIVISION, v)]
        problems += [f"schema {d['schema']!r}"] * (d["schema"] != SCHEMA)
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise Refused("verify", [f"descriptor: {e}"]) from None
    _refuse(problems)
    # 2: the layout
    problems = [f"unexpected {n}" for n in sorted(set(os.listdir(root)) - TOP)] + [f"missing {n}" for n in sorted(TOP - set(os.listdir(root)))]
    for below in ("mirror", "manifest"):
        if os.path.isdir(os.path.join(root, below)):
            wanted = set(d["divisions"]) if below == "mirror" else {f"{v}.jsonl" for v in d["divisions"]}
            problems += [f"unexpected {below}/{n}" for n in sorted(set(os.listdir(os.path.join(root, below))) - wanted)]
            problems += [f"missing {below}/{n}" for n in sorted(wanted - set(os.listdir(os.path.join(root, below))))]
    found = tree_hashes(spark, root).persist()
    problems += [f"no regular file: {p}" for p in _listed(found.where("kind <> 'file'"))]
    _refuse(problems)
    # 3: checksums
    problems = [f"{SUMS_FILE} has another hash"] * (file_hash(spark, os.path.join(root, SUMS_FILE)) != d["checksums_hash"])
    lines = spark.read.text(os.path.join(root, SUMS_FILE), lineSep="\n").withColumn("n", F.monotonically_increasing_id())
    bad = lines.where(~F.col("value").rlike("^[0-9a-f]{64}  [^\r]+$"))
    problems += [f"checksum line {r!r}" for r in _listed(bad, "value")]
    if shard.unended(os.path.join(root, SUMS_FILE)):
        problems.append(f"{SUMS_FILE} doesn't end its last line")
    _refuse(problems)
    listed = lines.select(F.substring("value", 1, 64).alias("hash"), F.expr("substring(value, 67)").alias("path"), "n")
    again = listed.groupBy("path").count().where("count > 1")
    tree = found.where(~F.col("path").isin(SUMS_FILE, DESCRIPTOR)).select("path", "hash")
    differing = render.compared(listed.select("path", "hash").dropDuplicates(["path"]), tree).where("state <> 'ok'")
    problems = [f"listed twice: {p}" for p in _listed(again)] + [f"{r.state}: {r.path}" for r in differing.orderBy("path").limit(1000).collect()]
    if not bundles.is_rising(listed, "path"):
        problems.append(f"{SUMS_FILE} is out of order")
    _refuse(problems)
    # 4: shards
    try:
        records = frame(spark, root, d["divisions"]).persist()
    except shard.ShardError as e:
        raise Refused("verify", [str(e)]) from None
    # 5: records and artifacts
    last = manifest.terminal(records)
    with open(os.path.join(root, RULES_FILE), encoding="utf-8") as file:
        version = json.load(file)["version"]
    text = last.where("text_path is not null")
    mirrored = found.where("path like 'mirror/%'").select(F.expr("substring(path, 8)").alias("path"), "hash")
    states = bundles.artifact_states(text, mirrored)
    problems = [f"other rules: {p}" for p in _listed(text.where(F.col("rules_version") != version), "source_path")] + [f"text path of {p}" for p in _listed(bundles.misplaced(last), "source_path")]
    problems += [f"no artifact: {p}" for p in _listed(states.where("state = 'missing'"), "text_path")] + [f"artifact differs: {p}" for p in _listed(states.where("state = 'differs'"), "text_path")]
    problems += [f"unreferenced: {p}" for p in _listed(bundles.unreferenced(mirrored, last))]
    _refuse(problems)
    # 6: collisions
    _refuse([f"paths fall together: {' '.join(r.paths)}" for r in manifest.collisions(text).limit(1000).collect()])
    # 7: counts and coverage
    counts, coverage = counts_of(records)
    problems = [f"{what} of {v}" for what, own, theirs in (("counts", counts, d["counts"]), ("coverage", coverage, d["coverage"])) for v in sorted(own.keys() | theirs.keys()) if own.get(v) != theirs.get(v)]
    found.unpersist()
    records.unpersist()
    _refuse(problems)
    return d


def _refuse(problems: list[str]) -> None:
    if problems:
        raise Refused("verify", problems)


def merge(spark: SparkSession, inputs: list[str], out: str) -> dict:
    """One bundle of several with different divisions and the same rules."""
    _new_folder("merge", out)
    described = [verify(spark, i) for i in inputs]
    divisions = [v for d in described for v in d["divisions"]]
    names = spark.createDataFrame([(v,) for v in divisions], "name string")
    problems = [f"divisions fall together: {' '.join(r.names)}" for r in bundles.folded_collisions(names).collect()]
    rules = spark.createDataFrame([(file_hash(spark, os.path.join(i, RULES_FILE)),) for i in inputs], "hash string")
    problems += ["the inputs' rules differ"] * (not bundles.rules_agreement(rules).first()["agree"])
    if problems:
        raise Refused("merge", problems)
    os.makedirs(out, exist_ok=True)
    for v in divisions:
        os.makedirs(os.path.join(out, "mirror", v))
    for i in inputs:
        for below in ("mirror", "manifest"):
            copy_tree(spark, os.path.join(i, below), os.path.join(out, below))
    shutil.copyfile(os.path.join(inputs[0], RULES_FILE), os.path.join(out, RULES_FILE))
    counts = {k: v for d in described for k, v in d["counts"].items()}
    coverage = {k: v for d in described for k, v in d["coverage"].items()}
    made = _describe(spark, out, sorted({r for d in described for r in d["run_ids"]}), sorted(divisions), counts, coverage)
    verify(spark, out)
    return made
