"""Runs over what arrives: each batch reads its own entries, contents are borrowed from earlier ones, batches aren't done twice."""

import os
import shutil

import pytest

from quillspark.plans import builders, run
from quillspark.sources import mirror, walk
from quillspark.streaming.incremental import follow


@pytest.fixture
def place(tmp_path):
    for name in ("src", "mirror", "man", "drop"):
        (tmp_path / name).mkdir()
    return tmp_path


def arrive(place, name, files):
    """A folder, or with one file a file, made beside the tree and moved in."""
    for path, data in files.items():
        target = place / "drop" / name / path if path else place / "drop" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.replace(place / "drop" / name, place / "src" / name)


def go(spark, place):
    query = follow(spark, str(place / "src"), str(place / "mirror"), str(place / "man"), "d1", str(place / "ckpt"), settle=0)
    query.awaitTermination(180)
    assert query.exception() is None


def records(place):
    path = place / "man/d1.jsonl"
    return path.read_text().splitlines() if path.exists() else []


def test_batches_hold_what_arrived(spark, place):
    arrive(place, "one", {"a.txt": b"first", "sub/deep/b.txt": b"second", "bad.txt": b"\xff"})
    go(spark, place)
    assert len(records(place)) == 3
    shutil.rmtree(place / "src/one/sub/deep")  # nobody looks there again: one itself is unchanged
    (place / "mirror/d1/one/a.txt.txt").write_text("tampered")
    arrive(place, "two", {"c.txt": b"second", "d.txt": b"first", "e.txt": b"third"})
    arrive(place, "pack.zip", {"": builders.zip_of([("m.txt", b"second"), ("n.txt", b"fourth")])})
    go(spark, place)
    last = {r["source_path"]: r for n in ("one/a.txt", "one/sub/deep/b.txt", "two/c.txt", "two/d.txt", "two/e.txt", "pack.zip.d/m.txt", "pack.zip.d/n.txt") for r in run.explain(spark, str(place / "man"), n)}
    assert len(records(place)) == 3 + 3 + 3
    assert {n: (r["status"], r["dedup_of"]) for n, r in last.items()} == {
        "one/a.txt": ("converted", None), "one/sub/deep/b.txt": ("converted", None), "two/c.txt": ("dedup", "one/sub/deep/b.txt"), "two/e.txt": ("converted", None),
        "two/d.txt": ("converted", None),  # the artifact it would borrow is damaged
        "pack.zip.d/m.txt": ("dedup", "one/sub/deep/b.txt"), "pack.zip.d/n.txt": ("converted", None),
    }
    assert (place / "mirror/d1/two/c.txt.txt").read_text() == "second"
    go(spark, place)  # nothing new
    assert len(records(place)) == 9


def test_what_is_replaced_arrives_again(spark, place):
    arrive(place, "pack.zip", {"": builders.zip_of([("m.txt", b"one"), ("n.txt", b"two")])})
    arrive(place, "other", {"x.txt": b"three"})
    go(spark, place)
    arrive(place, "pack.zip", {"": builders.zip_of([("m.txt", b"one")])})
    go(spark, place)
    assert run.explain(spark, str(place / "man"), "pack.zip.d/n.txt")[-1]["error"] == "container-member-removed"
    assert len(run.explain(spark, str(place / "man"), "other/x.txt")) == 1
    assert run.explain(spark, str(place / "man"), "pack.zip.d/m.txt")[-1]["status"] == "skipped_unchanged"


def test_a_batch_is_published_once(spark, place, monkeypatch):
    """The run dies after its commit, before its changes are in place; the batch that is tried again finds them and adds nothing."""
    arrive(place, "one", {"a.txt": b"first"})
    moved = mirror.Transaction.publish
    monkeypatch.setattr(mirror.Transaction, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        go(spark, place)
    assert records(place) == []
    monkeypatch.setattr(mirror.Transaction, "publish", moved)
    go(spark, place)
    assert len(records(place)) == 1 and '"converted"' in records(place)[0]
    assert (place / "mirror/d1/one/a.txt.txt").read_text() == "first"


def test_offsets(place):
    """Ties at one time, entries too young, and names that are never sources."""
    arrive(place, "one", {"a.txt": b"1"})
    arrive(place, "two", {"b.txt": b"2"})
    (place / "src/x.tmp").write_bytes(b"")
    reader = walk._Arrivals({"root": str(place / "src"), "settle": "0"})
    names = lambda start, end: sorted(r[0] for p in reader.partitions(start, end) for r in reader.read(p))
    end = reader.latestOffset()
    assert names(reader.initialOffset(), end) == ["one/a.txt", "two/b.txt"] and names(end, end) == []
    tied = {"time": end["time"], "names": []}  # another entry of the same time was seen
    assert names(tied, end) == [f"{n}/{'a' if n == 'one' else 'b'}.txt" for n in end["names"]]
    young = walk._Arrivals({"root": str(place / "src"), "settle": "3600"})
    assert young.latestOffset() == young.initialOffset()


def test_a_token_is_done_once(spark, place):
    arrive(place, "a.txt", {"": b"1"})
    args = (spark, str(place / "src"), str(place / "mirror"), str(place / "man"), "d1")
    assert run.run(*args, token="t1")["counts"]["converted"] == 1
    assert run.run(*args, token="t1")["records"] == 0 and len(records(place)) == 1
    assert run.run(*args, token="t2")["counts"]["skipped_unchanged"] == 1
