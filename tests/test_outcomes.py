"""Who is written and who borrows, against a walk one by one; the sink's protocol; the run over trees with copies and taken places."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_run import go, small

from quillspark.operators import outcomes
from quillspark.plans import builders, run
from quillspark.plans.folders import Kept
from quillspark.sources import mirror, shard


def records(tree):
    return {r["source_path"]: r for r in shard.decode((tree / "man/d1.jsonl").read_bytes(), strict=True)[0]}


def plain_walk(rows):
    """rows in order: (path, hash, converter, recorded or None). One by one, with files, folders and one slot for each hash."""
    files, folders, slot, out = set(), set(), {}, {}
    for path, digest, converter, recorded in rows:
        held = slot.get(digest)
        borrows = recorded is not None and held is not None and held[0] == converter
        mine = {path + e for e in outcomes.ENDINGS}
        above = {"/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)}
        if recorded is None:
            out[path] = ("failed", None)
        elif mine & folders or above & files:
            out[path] = ("failed", None)
        else:
            files |= mine
            folders |= above
            out[path] = ("dedup", held[1]) if borrows else ("converted", None)
            if not borrows:
                slot[digest] = (recorded, path)
    return out


def test_assigned_against_a_walk_one_by_one(spark, tmp_path):
    random.seed(4)
    names = ["a", "a.txt", "a.segments.jsonl", "b", "b.txt"]
    for turn in range(3):
        paths = {"/".join(random.choice(names) for _ in range(random.randint(1, 4))) for _ in range(120)}
        rows = []
        for p in sorted(paths):
            digest, converter = random.choice("uvwxyz"), random.choice("ab")
            rows.append((p, digest, converter, None if digest == "u" else "r" if (digest, converter) == ("v", "a") else converter))
        random.shuffle(rows)  # members of archives stand in any order
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "source_path string, source_hash string, converter string, recorded string, ord int")
        store = Kept(spark, str(tmp_path / f"t{turn}")).store
        lost = outcomes.blocked(df.where("recorded is not null").select("source_path", "ord"), store).withColumn("taken", F.lit("x"))
        done = outcomes.assigned(df.join(lost, "source_path", "left"), df.select("source_hash", "source_path", "converter").limit(0), store)
        assert {r.source_path: (r.status, r.dedup_of) for r in done.collect()} == plain_walk(rows)


def sink(spark, tmp_path):
    (tmp_path / "m").mkdir(exist_ok=True)
    return mirror.Transaction(spark, str(tmp_path / "m"), str(tmp_path / "d.jsonl"), "d")


def frames(spark, rows, lines=("x",)):
    artifacts = spark.createDataFrame([(t, None if b is None else bytearray(b), None if b is None else bytearray(b"s")) for t, b in rows], mirror.SCHEMA)
    return artifacts, spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def under(folder):
    return sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, names in os.walk(folder) for n in names)


def test_nothing_shows_before_the_commit(spark, tmp_path):
    change = sink(spark, tmp_path)
    artifacts, lines = frames(spark, [("d/a", b"one"), ("d/b/c", b"two"), ("d/gone", None)])
    (tmp_path / "m/d").mkdir()
    (tmp_path / "m/d/gone.txt").write_text("old")
    change.stage(artifacts, lines)
    assert [n for n in under(tmp_path / "m") if not n.startswith(".staged-d/")] == ["d/gone.txt"] and not (tmp_path / "d.jsonl").exists()
    change.publish()
    assert under(tmp_path / "m") == ["d/a.segments.jsonl", "d/a.txt", "d/b/c.segments.jsonl", "d/b/c.txt"]
    assert (tmp_path / "m/d/b/c.txt").read_bytes() == b"two" and (tmp_path / "d.jsonl").read_text() == "x\n"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    change = sink(spark, tmp_path)
    artifacts, lines = frames(spark, [(f"d/{k}", b"one") for k in range(40)])
    bad = artifacts.repartition(4).withColumn("target", F.when(F.col("target") == "d/7", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("target")))
    with pytest.raises(Exception, match="boom"):
        change.stage(bad, lines)
    assert [n for n in under(tmp_path / "m") if not n.startswith(".staged-d/lines")] == []
    assert not change.recover() and under(tmp_path) == []


def test_a_committed_change_is_carried_forward_from_wherever_it_ended(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("before\n")
    change = sink(spark, tmp_path)
    change.stage(*frames(spark, [("d/a", b"one"), ("d/b", b"two")], ("x", "y")))
    staged = [p for p in under(tmp_path / "m") if p.endswith("/0.txt")][0]
    tasks = json.loads((tmp_path / "m/.staged-d/COMMITTED").read_text())["tasks"]
    assert staged.split("/")[2] in tasks
    (tmp_path / "m/d").mkdir()
    first = json.loads((tmp_path / "m" / staged).with_name("index.jsonl").read_text().splitlines()[0])
    os.replace(first["staged"] + ".txt", tmp_path / "m" / (first["target"] + ".txt"))  # half of one artifact is there
    (tmp_path / "m/.staged-d/APPENDING").write_text("7")
    with open(tmp_path / "d.jsonl", "a") as out:
        out.write("x\nhalf")
    stray = tmp_path / "m/.staged-d/tasks/killed"
    stray.mkdir()
    (stray / "0.txt").write_text("never named")
    assert sink(spark, tmp_path).recover()
    assert under(tmp_path) == ["d.jsonl", "m/d/a.segments.jsonl", "m/d/a.txt", "m/d/b.segments.jsonl", "m/d/b.txt"]
    assert (tmp_path / "d.jsonl").read_text() == "before\nx\ny\n"
    assert not sink(spark, tmp_path).recover()


def test_copies_with_taken_places(spark, tmp_path):
    """A copy whose own place is taken fails alone; a copy of what could not be written is converted for itself."""
    tree = small(tmp_path, {"0.csv": b"same", "x.csv": b"same", "w/x.csv": b"same", "x.csv.txt/y.txt": b"other", "a.md": b"top", "a.md.txt/y.txt": b"inner", "z2.txt": b"inner", "z3.txt": b"inner"})
    assert go(spark, tree)["counts"] == {"converted": 3, "failed": 2, "unsupported": 0, "skipped_unchanged": 0, "dedup": 3}
    found = records(tree)
    assert found["a.md.txt/y.txt"]["error"].startswith("mirror_write_error") and found["a.md.txt/y.txt"]["converter_id"] == "text-passthrough"
    assert found["z2.txt"]["status"] == "converted" and found["z3.txt"]["dedup_of"] == "z2.txt" and (tree / "mirror/d1/z3.txt.txt").read_text() == "inner"
    assert found["x.csv"]["dedup_of"] == found["w/x.csv"]["dedup_of"] == "0.csv" and found["x.csv.txt/y.txt"]["status"] == "failed"
    assert not (tree / "mirror/.staged-d1").exists() and not (tree / "man/.run-d1").exists()


def test_copied_pictures_get_their_metadata(spark, tmp_path):
    picture = builders.png_of([("Title", "shared sentinel")], 30, 20)
    tree = small(tmp_path, {"a.png": picture, "b.png": picture, "c.zip": builders.zip_of([("d.png", picture)])})
    go(spark, tree)
    found = records(tree)
    for path in ("a.png", "b.png", "c.zip.d/d.png"):
        child = found[f"{path}.d/#image-metadata"]
        assert child["status"] == "converted" and child["parent_source"] == path and "dedup_of" not in child
        assert "shared sentinel" in (tree / f"mirror/d1/{path}.d/#image-metadata.txt").read_text()
    order = [json.loads(x)["source_path"] for x in (tree / "man/d1.jsonl").read_text().splitlines()]
    assert order == ["a.png", "a.png.d/#image-metadata", "b.png", "b.png.d/#image-metadata", "c.zip.d/d.png", "c.zip.d/d.png.d/#image-metadata", "c.zip"]


def test_equal_members_of_two_containers(spark, tmp_path):
    shared = b"shared member payload\n"
    tree = small(tmp_path, {"one.zip": builders.zip_of([("n.txt", b"x"), ("m.txt", shared)]), "two.zip": builders.zip_of([("m.txt", shared), ("k.md", shared)]), "zz.txt": shared})
    assert go(spark, tree)["counts"]["dedup"] == 3
    found = records(tree)
    assert found["one.zip.d/m.txt"]["status"] == "converted"
    assert all(found[p]["dedup_of"] == "one.zip.d/m.txt" for p in ("two.zip.d/m.txt", "two.zip.d/k.md", "zz.txt"))
    (tree / "src/zz2.txt").write_bytes(shared)
    (tree / "src/one.zip").unlink()
    assert go(spark, tree)["counts"] == {"converted": 0, "failed": 0, "unsupported": 0, "skipped_unchanged": 2, "dedup": 1}
    assert records(tree)["zz2.txt"]["dedup_of"] == "one.zip.d/m.txt"  # an intact artifact of an earlier run
    (tree / "mirror/d1/one.zip.d/m.txt.txt").unlink()
    (tree / "src/zz3.txt").write_bytes(shared)
    assert go(spark, tree)["counts"]["converted"] == 1 and records(tree)["zz3.txt"]["status"] == "converted"


def test_a_vanished_first_copy(spark, tmp_path):
    tree = small(tmp_path, {"a.txt": b"twin content\n", "b.txt": b"twin content\n"})
    go(spark, tree)
    for gone in ("src/a.txt", "mirror/d1/a.txt.txt", "mirror/d1/b.txt.txt"):
        (tree / gone).unlink()
    counts = go(spark, tree)["counts"]
    assert (counts["converted"], counts["failed"]) == (1, 0) and (tree / "mirror/d1/b.txt.txt").read_text() == "twin content\n"


def test_sources_that_change_while_the_run_reads_them(spark, tmp_path, monkeypatch):
    """The first of three copies can't be read any more: it fails alone, the others are read for themselves."""
    tree = small(tmp_path, {"a.txt": b"twin", "b.txt": b"twin", "c.txt": b"twin"})
    front = run.front

    def late(found, root):
        seen = front(found, root)
        rows = seen.collect()
        (tree / "src/a.txt").write_bytes(b"changed")
        return spark.createDataFrame(rows, seen.schema)

    monkeypatch.setattr(run, "front", late)
    counts = go(spark, tree)["counts"]
    found = records(tree)
    assert counts == {"converted": 1, "failed": 1, "unsupported": 0, "skipped_unchanged": 0, "dedup": 1}
    assert found["a.txt"]["error"] == "source_changed_during_run" and found["c.txt"]["dedup_of"] == "b.txt"


def test_a_run_that_dies_after_its_commit(spark, tmp_path, monkeypatch):
    tree = small(tmp_path, {"a.txt": b"one", "b.txt": b"two"})
    with monkeypatch.context() as m:
        m.setattr(mirror.Transaction, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            go(spark, tree)
    assert not (tree / "mirror/d1").exists() and not (tree / "man/d1.jsonl").exists()
    assert go(spark, tree)["counts"]["skipped_unchanged"] == 2
    assert (tree / "mirror/d1/a.txt.txt").read_text() == "one" and len((tree / "man/d1.jsonl").read_text().splitlines()) == 4
