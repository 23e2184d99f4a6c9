"""Runs, bundles and the command line over a small tree."""

import hashlib
import json
import os

import pytest
from conftest import DATA

from quillspark import cli
from quillspark.converters import media
from quillspark.operators import bundles
from quillspark.plans import builders, bundle, run
from quillspark.sources import shard, walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "docs/sub").mkdir(parents=True)
    for name, data in {
        "docs/crlf.txt": b"a\r\nb", "docs/dup-a.txt": b"same", "docs/dup-b.txt": b"same", "docs/sub/table.csv": b"a,b", "broken.txt": b"\xff", ".env": b"A=1",
        "p.zip": builders.zip_of([("in/a.txt", b"hello"), ("b.html", b"<p>x</p>")]), "old.tar": b"x", ".DS_Store": b"", "empty.txt": b"",
    }.items():
        (root / name).write_bytes(data)
    os.symlink("nowhere", root / "link")
    return tmp_path


def go(spark, tree, division="d1"):
    return run.run(spark, str(tree / "src"), str(tree / "mirror"), str(tree / "man"), division)


def test_run_again_and_after_changes(spark, tree):
    first = go(spark, tree)
    assert first["counts"] == {"converted": 8, "failed": 1, "unsupported": 2, "skipped_unchanged": 0, "dedup": 1}
    assert (tree / "mirror/d1/docs/crlf.txt.txt").read_bytes() == b"a\nb"
    assert (tree / "mirror/d1/p.zip.d/in/a.txt.txt").read_text() == "hello"
    assert run.explain(spark, str(tree / "man"), "docs/dup-b.txt")[0]["dedup_of"] == "docs/dup-a.txt"
    again = go(spark, tree)
    assert again["counts"]["converted"] == again["counts"]["dedup"] == 0 and again["counts"]["skipped_unchanged"] == 7
    (tree / "mirror/d1/docs/crlf.txt.txt").write_text("tampered")
    (tree / "src/p.zip").write_bytes(builders.zip_of([("in/a.txt", b"hello")]))
    with open(tree / "man/d1.jsonl", "a") as file:
        file.write('{"torn')
    third = go(spark, tree)
    # a member that stays as it was is taken over like any other unchanged source
    assert third["counts"]["converted"] == 2 and third["counts"]["skipped_unchanged"] == 6
    assert third["warnings"] == ["d1: discarded torn final line 23"]
    removed = run.explain(spark, str(tree / "man"), "p.zip.d/b.html")[-1]
    assert (removed["status"], removed["error"]) == ("failed", "container-member-removed")
    assert (tree / "mirror/d1/docs/crlf.txt.txt").read_bytes() == b"a\nb"
    status = run.status(spark, str(tree / "man"))
    assert status[0]["sources"] == 12


def small(tmp_path, files):
    for name, data in files.items():
        place = tmp_path / "src" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    return tmp_path


def test_folders_that_end_like_members(spark, tmp_path):
    """``conf.d/`` is an ordinary folder, even beside a source named conf."""
    tree = small(tmp_path, {"conf.d/x.txt": b"one", "a.txt": b"two", "conf": b"three", "deep.d/more.d/y.txt": b"four"})
    assert go(spark, tree)["counts"]["converted"] == 3
    assert go(spark, tree)["counts"]["skipped_unchanged"] == 3
    (tree / "mirror/d1/conf.d/x.txt.txt").write_text("tampered")
    assert go(spark, tree)["counts"] == {"converted": 1, "failed": 0, "unsupported": 1, "skipped_unchanged": 2, "dedup": 0}
    assert (tree / "mirror/d1/conf.d/x.txt.txt").read_text() == "one"


def test_nested_containers(spark, tmp_path):
    inner = builders.zip_of([("deep.txt", b"deep"), ("gone.txt", b"gone")])
    tree = small(tmp_path, {"z.zip": builders.zip_of([("in.zip", inner), ("top.txt", b"top")]), "conf.d/q.zip": builders.zip_of([("m.txt", b"m")])})
    first = go(spark, tree)["counts"]
    assert first["converted"] == 7 and first["failed"] == 0
    assert go(spark, tree)["counts"]["skipped_unchanged"] == 2
    (tree / "mirror/d1/z.zip.d/in.zip.d/deep.txt.txt").write_text("tampered")
    again = go(spark, tree)["counts"]
    assert again["converted"] == 3 and again["skipped_unchanged"] == 3  # two listings and the member that was changed
    assert (tree / "mirror/d1/z.zip.d/in.zip.d/deep.txt.txt").read_text() == "deep"
    (tree / "src/z.zip").write_bytes(builders.zip_of([("top.txt", b"top")]))
    assert go(spark, tree)["counts"]["failed"] == 3
    for name in ("in.zip", "in.zip.d/deep.txt", "in.zip.d/gone.txt"):
        last = run.explain(spark, str(tree / "man"), f"z.zip.d/{name}")[-1]
        assert (last["status"], last["error"], last["source_hash"], last["source_size"], last["detected_format"]) == ("failed", "container-member-removed", "", 0, "unknown")
        assert not (tree / f"mirror/d1/z.zip.d/{name}.txt").exists()
    assert go(spark, tree)["counts"]["failed"] == 0


def test_a_changed_sidecar_is_written_again(spark, tmp_path):
    tree = small(tmp_path, {"a.txt": b"one"})
    go(spark, tree)
    side = tree / "mirror/d1/a.txt.segments.jsonl"
    good = side.read_bytes()
    for bad in (good.replace(b'"end":3', b'"end":4'), b"{", good.replace(b"utf8_bytes", b"chars"), good + b"[]\n", good.replace(b'"start":0', b'"start":"0"')):
        side.write_bytes(bad)
        assert go(spark, tree)["counts"]["converted"] == 1
        assert side.read_bytes() == good


def test_damaged_shards(spark, tmp_path):
    tree = small(tmp_path, {"a.txt": b"one", "b.txt": b"two", "c.txt": b"three"})
    go(spark, tree)
    path = tree / "man/d1.jsonl"
    lines = path.read_bytes().split(b"\n")
    for bad in (b'{"garbage', lines[1] + b"\r", lines[1].replace(b'"status"', b'"stat"'), b"\xff" + lines[1], lines[1].replace(b":3,", b':"3",', 1), b""):
        path.write_bytes(b"\n".join([lines[0], bad, *lines[2:]]))
        with pytest.raises(shard.ShardError, match="line 2"):
            run.status(spark, str(tree / "man"))
        assert cli.main(["status", str(tree / "man")], spark) == 1
    path.write_bytes(b"\n".join(lines[:3]))  # the last line is whole and only lacks its end
    assert run.status(spark, str(tree / "man"))[0]["sources"] == 3
    with pytest.raises(bundle.Refused):
        bundle.bundle(spark, str(tree / "mirror"), str(tree / "man"), "d1", str(tree / "b"))
    assert go(spark, tree)["counts"]["skipped_unchanged"] == 3
    assert len(path.read_bytes().split(b"\n")) == 7
    path.write_bytes(path.read_bytes()[:-5])
    assert go(spark, tree)["warnings"] == ["d1: discarded torn final line 6"]
    other = lines[0].replace(shard.SCHEMA.encode(), b"elsewhere/manifest@1")
    with pytest.raises(shard.ShardError, match="schema"):
        shard.decode(other + b"\n")
    assert shard.decode(other + b"\n", accepted=("elsewhere/manifest@1",))[0][0]["source_path"] == "a.txt"


def heard(values, rate):
    return [media.Speech(0.0, 1.5, 1, "hello there")], {"language": "en", "model_id": "fake"}, "fake 1"


def seen(data, fmt):
    return [("A sign", 0.9), ("blurred", 0.2)]


def test_engines_and_all_record_fields(spark, tmp_path):
    tree = small(tmp_path, {"said.wav": builders.wave_of([1000, -1000] * 800), "copy.wav": builders.wave_of([1000, -1000] * 800), "sign.png": builders.png_of([("Title", "T")], 30, 20)})
    engines = {"speech": "test_run:heard", "recognition": "test_run:seen"}
    counts = run.run(spark, str(tree / "src"), str(tree / "mirror"), str(tree / "man"), "d1", engines)["counts"]
    assert counts["converted"] == 3 and counts["dedup"] == 1
    records = {r["source_path"]: r for r in shard.decode((tree / "man/d1.jsonl").read_bytes(), strict=True)[0]}
    first = records["copy.wav"]
    assert first["media"] == {"duration_seconds": 0.2, "language": "en", "model_id": "fake", "speaker_count": 1} and first["tool_version"] == "fake 1" and first["artifact_kind"] == "transcript"
    assert records["said.wav"]["media"] == first["media"] and records["said.wav"]["dedup_of"] == "copy.wav"
    assert all(r["duration_ms"] >= 0 for r in records.values())
    assert (tree / "mirror/d1/copy.wav.txt").read_text() == "[00:00:00 -> 00:00:01] Speaker 1: hello there\n"
    assert (tree / "mirror/d1/sign.png.txt").read_text() == "A sign\nblurred\n" and records["sign.png"]["warnings"] == ["image_ocr_low_confidence: 1 of 2 lines"]
    again = run.run(spark, str(tree / "src"), str(tree / "mirror"), str(tree / "man"), "d1", engines)["counts"]
    assert again["skipped_unchanged"] == 3
    records = shard.decode((tree / "man/d1.jsonl").read_bytes(), strict=True)[0]
    assert [r["media"] for r in records if r["source_path"] == "said.wav"] == [first["media"]] * 2


def test_walk_opens_folders_for_parts(spark, tmp_path):
    tree = small(tmp_path, {f"one/{a}/{b}.txt": b"x" for a in range(6) for b in range(5)})
    found = run.entries(spark, str(tree / "src"))
    assert found.rdd.getNumPartitions() > 4
    assert [r.path for r in found.orderBy("ord").collect()] == [e[0] for e in walk.walk(str(tree / "src"))]


def test_order_over_partitions(spark):
    paths = [f"p{k:04}" for k in range(200)]
    frame = lambda rows: spark.createDataFrame([(p,) for p in rows], "path string").repartition(1)
    assert bundles.is_rising(spark.createDataFrame([(p,) for p in paths], "path string"), "path")
    assert bundles.is_rising(frame([]), "path") and not bundles.is_rising(frame(["b", "a"]), "path") and not bundles.is_rising(frame(["a", "a"]), "path")
    assert not bundles.is_rising(spark.createDataFrame([(p,) for p in [*paths[100:], *paths[:100]]], "path string"), "path")


def test_layout_is_refused(spark, tree):
    with pytest.raises(run.Refused):
        run.run(spark, str(tree / "src"), str(tree / "src/mirror"), str(tree / "man"), "d1")
    with pytest.raises(run.Refused):
        go(spark, tree, "bad name")
    assert not (tree / "man").exists()


def test_bundle_verify_merge(spark, tree):
    go(spark, tree)
    go(spark, tree, "d2")
    out = {v: str(tree / f"b-{v}") for v in ("d1", "d2", "all")}
    for v in ("d1", "d2"):
        bundle.bundle(spark, str(tree / "mirror"), str(tree / "man"), v, out[v])
    merged = bundle.merge(spark, [out["d1"], out["d2"]], out["all"])
    assert merged["divisions"] == ["d1", "d2"]
    assert cli.main(["verify", out["all"]], spark) == 0
    with pytest.raises(bundle.Refused):
        bundle.merge(spark, [out["d1"], out["d1"]], str(tree / "twice"))
    with open(os.path.join(out["all"], "mirror/d1/.env.txt"), "a") as file:
        file.write("x")
    assert cli.main(["verify", out["all"]], spark) == 3
    described = json.load(open(os.path.join(out["d2"], "BUNDLE.json")))
    described["counts"]["d2"]["converted"] += 1
    json.dump(described, open(os.path.join(out["d2"], "BUNDLE.json"), "w"))
    with pytest.raises(bundle.Refused, match="counts"):
        bundle.verify(spark, out["d2"])
    open(os.path.join(out["d1"], "mirror/d1/stray.tmp"), "w").close()
    with pytest.raises(bundle.Refused):
        bundle.verify(spark, out["d1"])


def test_command_line(spark, tree, capsys):
    assert cli.main(["nope"], spark) == 2
    assert cli.main(["scan", str(tree / "src")], spark) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 10
    assert cli.main(["status", str(tree / "absent")], spark) == 1


def test_shard():
    record = {"source_path": "a", "source_hash": "", "source_size": 1, "detected_format": "text", "format_mismatch": False, "status": "failed", "rules_version": "10", "error": "e", "warnings": []}
    line = shard.encode(record).encode()
    assert shard.decode(line)[0][0]["error"] == "e" and b"warnings" not in line
    assert shard.decode(line + line[:9])[1] == ["discarded torn final line 2"]
    for bad in (line + line[:9], line.replace(b'"error"', b'"errors"'), line.replace(b"\n", b"\r\n"), line.replace(b"failed", b"dedup")):
        with pytest.raises(shard.ShardError):
            shard.decode(bad, strict=True)


def test_watch(spark, tree):
    from quillspark.streaming.incremental import watch

    query = watch(spark, str(tree / "src"), str(tree / "mirror"), str(tree / "man"), "d1", str(tree / "ckpt"))
    query.awaitTermination(120)
    assert run.status(spark, str(tree / "man"))[0]["sources"] == 12


def test_mirror_is_read_by_its_records(spark, tmp_path):
    """Tasks open what records name, once: a text that is missing, another one, or without its sidecar is left out."""
    from quillspark.plans.queries import QUERIES
    from quillspark.sources import mirror

    def put(stem, text, side=True):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"{stem}.txt").write_bytes(text)
        if side:
            (tmp_path / "d" / f"{stem}.segments.jsonl").write_bytes(b"{}\n")

    sha = lambda b: hashlib.sha256(b).hexdigest()
    put("a", "é".encode()), put("b", b"other"), put("c", b"bare", side=False), put("e", b""), put("x.txt", b"dotted")
    rows = [("a", sha("é".encode())), ("b", sha(b"b")), ("c", sha(b"bare")), ("gone", sha(b"")), ("e", sha(b"")), ("x.txt", sha(b"dotted"))]
    records = spark.createDataFrame([(f"d/{n}.txt", h) for n, h in rows] + [(None, None)], "text_path string, text_hash string")
    found = {r.text_path: (r.text_bytes, r.sidecar_hash) for r in mirror.read_back(records, str(tmp_path)).collect()}
    assert found == {f"d/{n}.txt": (size, sha(b"{}\n")) for n, size in (("a", 2), ("e", 0), ("x.txt", 6))}
    plan = QUERIES["mirror_roundtrip"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "Join" not in plan
