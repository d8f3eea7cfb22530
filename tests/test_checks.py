from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions import cells, curve, markers, sql
from orbweave.operators import checks, covers, retrieval
from orbweave.streaming.markers import stream_keys
from tests.conftest import SMALL


def test_range_and_prefix_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(3000).select("id", markers.marker(F.array(F.col("id") * 1.0, F.lit(3.0), F.sin("id"))).alias("marker"), cells.from_lat_lng(F.col("id") % 170 - 85.0, F.col("id") % 350 - 175.0).alias("cell"))
    rows.write.parquet(str(tmp_path / "t"))
    table, head = spark.read.parquet(str(tmp_path / "t")), markers.Space().prefix
    keys = sorted(r.marker for r in table.collect())
    ranges, start = [(keys[100], keys[400]), (keys[-900], keys[-700])], keys[1500][: len(head) + 1]
    half = (1 << 63) - 5
    tests = [
        (retrieval.in_ranges(F.col("marker"), ranges), lambda r: any(a <= r.marker <= b for a, b in ranges), ["GreaterThanOrEqual(marker", "LessThanOrEqual(marker"]),
        (retrieval.has_prefix(F.col("marker"), start), lambda r: r.marker.startswith(start), ["StringStartsWith(marker"]),
        (retrieval.in_cell_ranges(F.col("cell"), [(1 << 61, half), (half + 20, 5 << 61), (3 << 61, 3 << 61 | 9)]), lambda r: 1 << 61 <= r.cell % (1 << 64) <= half or half + 20 <= r.cell % (1 << 64) <= 5 << 61, ["GreaterThanOrEqual(cell", "LessThanOrEqual(cell"]),
    ]
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    for condition, keeps, pushed in tests:
        found = table.where(condition)
        plan = found._jdf.queryExecution().toString()
        assert all(p in plan.split("PushedFilters")[1] for p in pushed)
        got = {r.id for r in found.collect()}
        assert got == {r.id for r in table.collect() if keeps(r)} and 0 < len(got) < 3000


def test_checks_over_tables(spark):
    rows = spark.createDataFrame([(i, i * 7, "E" if i in (9, 4, 30) else None) for i in range(40)], "id long, h long, e string")
    for parts in (1, 5):
        dealt = rows.repartition(parts, "h")
        assert tuple(checks.checksum(dealt, "h").first()) == (40, reduce(int.__xor__, (i * 7 for i in range(40))), 780 * 7)
        assert [tuple(r) for r in checks.first_failing(dealt, "id", F.col("e")).collect()] == [(4, "E")]
    assert checks.first_failing(rows, "id", F.lit(None).cast("string")).count() == 0
    assert checks.require_rows(rows).count() == 40
    with pytest.raises(ValueError, match="no rows in points"):
        checks.require_rows(rows.where("id > 99"), "points")


def test_sql_names(spark):
    sql.register(spark)
    spark.createDataFrame([(1, 5, 9, 4, [1.0, 2.0, 3.0], 37.4, -122.1), (2, 100, 31, 8, [0.0, 0.0], None, 0.0), (3, 1, 1, 4, None, 1.0, 2.0)], "id int, x long, y long, bits int, e array<float>, lat double, lng double").createOrReplaceTempView("named")
    got = {r.id: r for r in spark.sql("SELECT id, hilbert_encode2(x, y, bits) AS h, hilbert_decode2(hilbert_encode2(x, y, bits), bits) AS p, hk1_marker(e) AS m, hk2_keys(e) AS k, cell_id(lat, lng, 12) AS c FROM named").collect()}
    want = {r.id: r for r in spark.table("named").select("id", F.when(F.col("bits") == 4, curve.encode2("x", "y", 4)).otherwise(curve.encode2("x", "y", 8)).alias("h"), markers.marker("e", invalid="null").alias("m"), cells.from_lat_lng("lat", "lng", 12, invalid="null").alias("c")).collect()}
    assert all((got[i].h, got[i].m, got[i].c) == (want[i].h, want[i].m, want[i].c) for i in want)
    assert tuple(got[1].p) == (5, 9) and tuple(got[2].p) == (100, 31) and got[3].k is None and len(got[1].k) == 16
    walk = spark.sql("SELECT * FROM curve_walk(3, 4, 100, 50)").collect()
    assert [(int(r["index"]), r.point) for r in walk] == [(r["index"], r.point) for r in curve.curve_walk(spark, 3, 4, 100, 50).orderBy("index").collect()]
    ranges = spark.sql("SELECT * FROM probe_ranges(array(1.0f, 2.0f, 3.0f), 2, 4)").collect()
    assert [r.lo[:4] for r in ranges] == ["8f08", "8f0b", "8ff4", "8ff7"]
    cover = {r.cell for r in spark.sql("SELECT * FROM cover_cells(37.4, -122.1, 1000.0)").collect()}
    own = spark.range(1).select(cells.covering(F.lit(37.4), F.lit(-122.1), 1000.0, as_cells=True).alias("c")).first().c
    assert cover == set(own)


def test_cover_cells_in_a_lateral_join_runs_on_batches(spark):
    """Cells of discs of all sizes, as ``covering`` gives them; nulls give none; no function is called row by row."""
    sql.register(spark)
    rows = [(k, (k * 37 % 180) - 89.5, (k * 91 % 360) - 180.0, k * k * 1500) for k in range(80)] + [(100, None, 1.0, 5), (101, 1.0, 1.0, None)]
    places = spark.createDataFrame(rows, "id long, lat double, lng double, r long")
    places.createOrReplaceTempView("discs")
    found = spark.sql("SELECT id, c.cell FROM discs, LATERAL cover_cells(lat, lng, r) c")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan and "Join" not in plan
    want = places.where("id < 100").select("id", F.explode(cells.covering("lat", "lng", "r", as_cells=True)).alias("cell"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_wide_walks_and_points(spark):
    """Across the border of the low word, against decoding each index; and points as structs."""
    start = (5 << 64) - 3
    got = {r["index"]: r.point for r in curve.curve_walk(spark, 16, 8, start, 7).collect()}
    assert sorted(got) == [f"{start + k:032x}" for k in range(7)]
    steps = [got[f"{start + k:032x}"] for k in range(7)]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(steps, steps[1:]))
    with pytest.raises(errors.IndexOutOfRange):
        curve.curve_walk(spark, 16, 8, (1 << 128) - 3, 7)
    rows = spark.range(64).select("id", curve.encode2_point(curve.decode2("id", 3), 3).alias("again"))
    assert all(r.id == r.again for r in rows.collect())


def test_null_and_wrong_cells(spark):
    rows = spark.createDataFrame([(0.0, 0.0, None), (0.0, None, 5.0), (0.0, 0.0, 5.0)], "lat double, lng double, r double")
    assert [r.c is None for r in rows.coalesce(1).select(cells.covering("lat", "lng", "r").alias("c")).collect()] == [True, True, False]
    at = spark.createDataFrame([(0, 5, 9), (6, 0, 0), (1, 1 << 30, 0), (2, 0, -1), (3, None, 1)], "f int, i long, j long").coalesce(1)
    assert [r.c is None for r in at.select(cells.from_face_ij("f", "i", "j", invalid="null").alias("c")).collect()] == [False, True, True, True, True]
    with pytest.raises(Exception, match="CoordinateOutOfRange"):
        at.select(cells.from_face_ij("f", "i", "j")).collect()
    assert [r.c for r in at.select(cells.token(cells.from_face("f")).alias("c")).collect()] == ["1", None, "3", "5", "7"]


class Band:
    """A user's region: all cells whose centre lies on faces 0 and 3, but only leaves of one cell are inside for sure."""

    def may_intersect(self, ids):
        return (ids >> np.uint64(61)) % 3 == 0

    def contains(self, ids):
        return cells.levels(ids) >= 1


def test_cover_of_a_users_region(spark):
    found = covers.cover(Band(), max_level=4, max_cells=20)
    assert sorted(c >> 61 for c in found) == [0] * 4 + [3] * 4 and {int(x) for x in cells.levels(np.array(found, np.uint64))} == {1}


def test_stream_keys_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":1,"embedding":[1,2,3]}\n[3,2,1]\n[0,0]\n')
    query = stream_keys(spark, str(tmp_path / "in"), width=3).writeStream.format("memory").queryName("keyed").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    from orbweave.functions import lsh

    want = {tuple(r.k) for r in spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 2.0, 1.0],)], "e array<float>").select(lsh.keys("e").alias("k")).collect()}
    rows = spark.table("keyed").collect()
    assert {tuple(r["keys"]) for r in rows if r.error is None} == want and len(rows) == 3


def test_recall_counts_hits(spark):
    exact = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "query_id long, id long")
    assert tuple(retrieval.recall(exact, exact.where("id = 3").unionByName(exact.where("id = 3"))).first()) == (2, 3, 2 / 3)


def test_entry_has_a_query_for_each_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and SMALL == __spark_entry__.SMALL
