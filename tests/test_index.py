"""The manifest's index: equal to the shards as they grow, are cut or replaced; look-ups prune."""

import os

import pytest

from pyspark.sql import functions as F

from quillspark.plans import run
from quillspark.sources import shard
from quillspark.sources.index import Index


def line(path, size=1, content="h"):
    return shard.encode({"source_path": path, "source_hash": content, "source_size": size, "detected_format": "text", "format_mismatch": False, "status": "failed", "rules_version": "10", "error": "e", "warnings": []})


def append(folder, division, text):
    with open(folder / f"{division}.jsonl", "a") as file:
        file.write(text)


def sizes(spark, folder, path):
    return [(r["division"], r["source_size"]) for r in run.explain(spark, str(folder), path)]


def test_index_follows_shards(spark, tmp_path):
    append(tmp_path, "a", "".join(line(f"p{k}", k) for k in range(50)))
    append(tmp_path, "b", line("p7", 70))
    assert sizes(spark, tmp_path, "p7") == [("a", 7), ("b", 70)]
    append(tmp_path, "a", line("p7", 8) + line("p7", 9))
    assert sizes(spark, tmp_path, "p7") == [("a", 7), ("a", 8), ("a", 9), ("b", 70)]
    append(tmp_path, "a", line("p7", 10).rstrip("\n"))  # whole, but not ended
    assert sizes(spark, tmp_path, "p7") == [("a", 7), ("a", 8), ("a", 9), ("a", 10), ("b", 70)]
    append(tmp_path, "a", "\n" + line("p7", 11)[:9])  # ended, and a torn one behind it
    assert sizes(spark, tmp_path, "p7") == [("a", 7), ("a", 8), ("a", 9), ("a", 10), ("b", 70)]
    (tmp_path / "a.jsonl").write_text(line("p7", 1))  # another shard
    assert sizes(spark, tmp_path, "p7") == [("a", 1), ("b", 70)]
    assert sizes(spark, tmp_path, "none") == []


def test_empty_manifest_and_bad_lines(spark, tmp_path):
    assert sizes(spark, tmp_path, "p") == []
    append(tmp_path, "a", "")
    assert sizes(spark, tmp_path, "p") == []
    append(tmp_path, "a", line("p") + "{}\n")
    with pytest.raises(shard.ShardError):
        run.explain(spark, str(tmp_path), "p")
    (tmp_path / "a.jsonl").write_text(line("p"))
    assert sizes(spark, tmp_path, "p") == [("a", 1)]


def test_generations_stay_few(spark, tmp_path):
    """Equal steps are merged like the digits of a binary counter."""
    index = Index(spark, str(tmp_path))
    standing = []
    for k in range(6):
        append(tmp_path, "a", line(f"p{k}", 5))
        standing.append(len(index.refresh("a")))
    assert standing == [1, 1, 2, 1, 2, 2]
    assert sorted(r.source_path for r in index.records().collect()) == [f"p{k}" for k in range(6)]
    folders = [n for n in os.listdir(tmp_path / ".index/division=a") if n.startswith("generation")]
    assert len(folders) == 2


def test_look_ups_prune(spark, tmp_path):
    for d in ("a", "b"):
        append(tmp_path, d, "".join(line(f"{d}/{k:05d}", k, f"{k:064d}") for k in range(3000)))
    index = Index(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few thousand records would be one file
    index.refresh("a"), index.refresh("b")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = index.history((F.col("division") == "b") & (F.col("source_path") == "b/01234"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(division" in plan and "EqualTo(source_path,b/01234)" in plan
    assert [r.source_size for r in one.collect()] == [1234]
    assert [r.division for r in index.history(F.col("source_hash") == f"{77:064d}").collect()] == ["a", "b"]
    import pyarrow.parquet as pq

    place = tmp_path / ".index/division=b"
    files = [os.path.join(f, n) for f, _, names in os.walk(place) for n in names if n.endswith(".parquet")]
    ranges = []
    jvm = spark._jvm.org.apache.parquet.hadoop
    source = jvm.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(files[0]), spark._jsc.hadoopConfiguration())
    reader = jvm.ParquetFileReader.open(source)
    filtered = {c.getPath().toDotString() for c in reader.getFooter().getBlocks()[0].getColumns() if c.getBloomFilterOffset() > 0}
    reader.close()
    assert filtered == {"source_path", "source_hash"}
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = {meta.row_group(0).column(c).path_in_schema: meta.row_group(0).column(c) for c in range(meta.num_columns)}
        ranges.append((at["source_path"].statistics.min, at["source_path"].statistics.max))
    assert len(files) > 1 and all(b[0] > a[1] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
