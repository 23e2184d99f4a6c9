"""The segmented scan and the interval join against plain loops, with one key over many ranges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup, intervals, manifest, render
from quillspark.operators.scan import Scan
from quillspark.plans.folders import Kept


@pytest.fixture
def ranges(spark):
    """As many ranges as asked for, however small."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(rows):
    total, before, last, out = defaultdict(int), {}, {}, {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        total[key] += value or 0
        if value is not None:
            last[key] = value
        out[at] = (total[key], before.get(key), last.get(key))
        before[key] = value
    return out


@pytest.mark.parametrize("hot", [0.0, 0.9, 1.0])
def test_scan_against_a_loop(spark, ranges, tmp_path, hot):
    random.seed(int(10 * hot))
    rows = [("hot" if random.random() < hot else random.choice(["a", "b", "c", None]), k, random.choice([None, None, 1, 2, 3])) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, at int, value int").repartition(5)
    kept = Kept(spark, str(tmp_path))
    scan = Scan(df, ["key"], ["at"], kept.store)
    parts = kept.store(scan._all.groupBy("_part").agg(F.count_distinct("_key").alias("keys")), "parts").collect()
    assert len(parts) >= 5
    done = scan.sum("total", F.coalesce("value", F.lit(0))).lag("before", F.col("value")).last("last", F.col("value"))
    assert done.columns == ["key", "at", "value", "total", "before", "last"]
    assert {r["at"]: (r.total, r.before, r["last"]) for r in done.rows.collect()} == plain(rows)


def test_scan_of_nothing_and_of_one_row(spark, tmp_path):
    df = spark.createDataFrame([], "key string, at int")
    assert Scan(df, ["key"], ["at"], Kept(spark, str(tmp_path / "a")).store).sum("n", F.lit(1)).rows.count() == 0
    one = spark.createDataFrame([(None, None)], "key string, at int")
    assert [tuple(r) for r in Scan(one, ["key"], ["at"], Kept(spark, str(tmp_path / "b")).store).sum("n", F.lit(1)).lag("l", F.col("at")).rows.collect()] == [(None, None, 1, None)]


def test_numbers_claims_and_budget_in_many_ranges(spark, ranges, tmp_path):
    kept = lambda n: Kept(spark, str(tmp_path / n)).store
    df = spark.createDataFrame([("r", k, f"{'A' if k % 3 else 'a'}{k // 2}", k % 7) for k in range(300)], "root string, ord int, path string, size long").repartition(6)
    assert sorted((r["ord"], r.n) for r in render.numbered(df, [F.col("ord")], "n", kept("n")).collect()) == [(k, k + 1) for k in range(300)]
    totals = {r["ord"]: (r.total, r.fits) for r in manifest.expansion_budget(df, 500, kept("b")).collect()}
    assert totals == {k: (sum(j % 7 for j in range(k + 1)), sum(j % 7 for j in range(k + 1)) <= 500) for k in range(300)}
    seen, refused, want = set(), 0, {}
    for k in range(300):
        name = f"{'A' if k % 3 else 'a'}{k // 2}"
        if name.lower() in seen:
            refused += 1
        want[k] = f"r.d/#collision-{refused}" if name.lower() in seen else f"r.d/{name}"
        seen.add(name.lower())
    assert {r["ord"]: r.child_path for r in manifest.claims(df, kept("c")).collect()} == want


def test_islands_of_one_content_in_many_ranges(spark, ranges, tmp_path):
    random.seed(2)
    rows = [("h", k, f"p{k:04}", random.choice("aab")) for k in range(500)]
    df = spark.createDataFrame(rows, "source_hash string, ord int, source_path string, converter string").repartition(7)
    slot, want = None, {}
    for _, _, path, converter in rows:
        if slot and slot[0] == converter:
            want[path] = ("dedup", slot[1])
        else:
            want[path], slot = ("converted", None), (converter, path)
    assert {r.source_path: (r.status, r.dedup_of) for r in dedup.dedup_islands(df, Kept(spark, str(tmp_path)).store).collect()} == want


def test_order_breaks(spark, ranges, tmp_path):
    names = [f"p{k:03}" for k in range(200)]
    names[50], names[51], names[120] = names[51], names[50], names[119]  # an inversion, and a repeated name
    df = spark.createDataFrame(list(enumerate(names)), "place int, path string").repartition(5)
    found = render.order_breaks(df, "place", "path", Kept(spark, str(tmp_path)).store)
    assert sorted(r.place for r in found.where("not rising").collect()) == [51, 120]


def test_cells_cover_a_range_once(spark):
    random.seed(5)
    pairs = [(a, b) for a in range(9) for b in range(a - 1, 20)] + [(random.randrange(1 << 40), random.randrange(1 << 41)) for _ in range(60)] + [(0, (1 << 62) - 1), (0, 1 << 62), (-5, 3), ((1 << 62) - 1, (1 << 62) - 1)]
    df = spark.createDataFrame(pairs, "first long, last long").select("first", "last", intervals.cells(F.col("first"), F.col("last")).alias("cells"))
    for r in df.collect():
        parts = sorted((c["at"] << c["level"], (c["at"] + 1) << c["level"]) for c in r.cells)
        low, high = max(r.first, 0), min(r["last"], (1 << 62) - 1) + 1
        if low >= high:
            assert not parts
            continue
        assert parts[0][0] == low and parts[-1][1] == high and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * max(1, (high - low).bit_length())


def test_containing_against_all_pairs(spark):
    random.seed(6)
    points = [(random.choice("xyz"), random.choice([None, -3, *range(200)]), k) for k in range(400)] + [(None, 5, 900)]
    ranges = [(random.choice("xyz"), a, a + random.choice([-1, 0, 1, 5, 60]), k) for k, a in enumerate(random.choices(range(-20, 200), k=80))] + [("x", None, 9, 901), ("x", 1, None, 902), (None, 0, 9, 903)]
    found = intervals.containing(spark.createDataFrame(points, "key string, point long, id int"), spark.createDataFrame(ranges, "key string, first long, last long, r int"), ["key"], "point")
    want = {(p[2], r[3]) for p in points for r in ranges if p[0] is not None and p[0] == r[0] and None not in (p[1], r[1], r[2]) and p[1] >= 0 and r[1] <= p[1] <= r[2]}
    assert len(want) > 100 and sorted((r.id, r.r) for r in found.collect()) == sorted(want)
    assert intervals.containing(spark.createDataFrame(points, "key string, point long, id int"), spark.createDataFrame([], "key string, first long, last long, r int"), ["key"], "point").count() == 0


def test_few_ranges_shuffle_no_points(spark):
    """A handful of cells is broadcast: else all points of a common cell would be sorted in one task."""
    points = spark.range(2000).select((F.col("id") % 7).alias("n"), "id")
    ranges = spark.createDataFrame([(2, 3), (6, 6), (3, 2)], "first int, last int")
    met = intervals.containing(points, ranges, [], "n")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert sorted(r.id for r in met.collect()) == [k for k in range(2000) if k % 7 in (2, 3, 6)]
