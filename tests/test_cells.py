import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions import cells
from orbweave.functions.unsigned import sortable, unsigned_decimal
from orbweave.operators import covers, retrieval

POINTS = [
    (0.0, 0.0, 1152921504606846977), (0.0, 90.0, 3458764513820540929), (90.0, 0.0, 5764607523034234881), (0.0, 180.0, 8070450532247928831),
    (0.0, -90.0, 10376293541461622785), (-90.0, 0.0, 12682136550675316737), (37.4, -122.1, 9263817276881359979), (-33.9, 151.2, 7715424573867261831),
    (89.0, 10.0, 4996161554607737651), (-45.0, 179.0, 12106205811951962285), (0.1, 0.1, 1152926196071403833),
]
DISC = [(9263817022326702081, 9263817159765655551), (9263817159765655553, 9263817297204609023), (9263817297204609025, 9263817434643562495), (9263824306591236097, 9263824444030189567), (9263824444030189569, 9263824581469143039), (9263827467687165953, 9263827605126119423), (9263827880004026369, 9263828017442979839)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_published_leaves(spark):
    rows = spark.createDataFrame([(a, b, str(c)) for a, b, c in POINTS], "lat double, lng double, want string")
    assert rows.where(unsigned_decimal(cells.from_lat_lng("lat", "lng")).cast("string") != F.col("want")).count() == 0


def test_hierarchy(spark):
    c = cells.from_lat_lng("lat", "lng")
    rows = spark.createDataFrame([(a, b) for a, b, _ in POINTS], "lat double, lng double").select(c.alias("leaf"))
    for level in (0, 1, 12, 29, 30):
        p = cells.parent("leaf", level)
        bad = rows.where((cells.level(p) != level) | ~cells.contains(p, "leaf") | ~cells.valid(p) | (cells.face(p) != cells.face("leaf")) | (cells.from_token(cells.token(p)) != p))
        assert bad.count() == 0
    kids = rows.select(cells.parent("leaf", 7).alias("p")).select("p", F.explode(cells.children("p")).alias("c"))
    assert kids.where((cells.parent("c", 7) != F.col("p")) | (cells.level("c") != 8)).count() == 0
    assert rows.where(cells.leaf("leaf")).count() == len(POINTS)
    row = spark.range(1).select(cells.token(F.lit(0)).alias("x"), cells.from_token(F.lit("X")).alias("none"), cells.valid(F.lit(0)).alias("ok"), cells.from_face_pos_level(F.lit(3), F.lit(0x12345678), 26).alias("c")).first()
    assert (row.x, row.none, row.ok) == ("X", None, False)
    facts = spark.range(1).select(*(cells.pos(x).alias(n) for n, x in {"c": F.lit(row.c), "k": cells.child(F.lit(row.c), 0), "kk": cells.child(cells.child(F.lit(row.c), 0), 0), "p": cells.parent(F.lit(row.c), 25), "pp": cells.parent(F.lit(row.c), 24)}.items())).first()
    assert tuple(facts) == (0x12345700, 0x12345640, 0x12345610, 0x12345400, 0x12345000)


def test_neighbours_are_mutual(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in POINTS], "lat double, lng double").select(cells.parent(cells.from_lat_lng("lat", "lng"), 9).alias("c"))
    beside = rows.select("c", F.explode(cells.edge_neighbours("c")).alias("n")).select("c", "n", cells.edge_neighbours("n").alias("back"))
    assert beside.where(~F.array_contains("back", F.col("c")) | (cells.level("n") != 9)).count() == 0
    centre = rows.select("c", cells.center("c").alias("p")).select("c", cells.from_lat_lng("p.lat", "p.lng", 9).alias("again"))
    assert centre.where("c <> again").count() == 0


def test_errors(spark):
    rows = spark.createDataFrame([(91.0, 0.0), (float("nan"), 0.0), (0.0, None)], "lat double, lng double")
    assert [r.c for r in rows.select(cells.from_lat_lng("lat", "lng", invalid="null").alias("c")).collect()] == [None] * 3
    with pytest.raises(Exception, match="LatitudeOutOfRange"):
        rows.where("lat = 91").select(cells.from_lat_lng("lat", "lng")).collect()
    with pytest.raises(errors.LevelOutOfRange):
        cells.from_lat_lng("lat", "lng", 31)
    for make, error in ((lambda: covers.Polygon([(1, 2), (3, 4)]), errors.RegionOutOfRange), (lambda: covers.Cap(0, 0, -1), errors.RadiusOutOfRange), (lambda: covers.cover(covers.Cap(0, 0, 1), max_cells=0), errors.CoverOptionsOutOfRange), (lambda: covers.cover(covers.Cap(0, 0, 1), min_level=9, max_level=3), errors.CoverOptionsOutOfRange), (lambda: covers.merge_cells([0]), errors.InvalidCell), (lambda: covers.cover(covers.Cap(0, 0, 9e6), min_level=9), errors.CoverTooLarge)):
        with pytest.raises(error):
            make()


def test_covers_match_published_ranges(spark):
    assert covers.merge_cells(covers.cover(covers.Cap(37.4, -122.1, 1000), max_level=12, max_cells=8)) == DISC
    assert len(covers.merge_cells(covers.cover(covers.Chain([(10, 10), (10.2, 10.3)]), max_level=12, max_cells=8))) == 8
    assert len(covers.merge_cells(covers.cover(covers.Polygon([(20, 20), (20, 20.2), (20.2, 20.1)]), max_level=12, max_cells=16))) == 16
    assert covers.cover(covers.Chain([])) == []
    ids = spark.createDataFrame([([signed((a + b) // 2) for a, b in DISC],)], "c array<long>")
    got = ids.select(cells.merged_ranges(F.col("c")).alias("r")).first().r
    assert [(r.lo % (1 << 64), r.hi % (1 << 64)) for r in got] == DISC


def turning(ring, p):
    """How often a ring turns around a point, by angles on its tangent plane."""
    total = 0.0
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        s, t = (x - p * (x @ p) for x in (a, b))
        total += np.arctan2(p @ np.cross(s, t), s @ t)
    return round(total / (2 * np.pi))


def rings(rng, n):
    """Star-shaped rings around random places, also over poles and face edges."""
    for _ in range(n):
        lat, lng, size = rng.uniform(-90, 90), rng.uniform(-180, 180), 10 ** rng.uniform(-2, 1.4)
        centre = cells.unit_vectors(np.array(lat), np.array(lng))
        east = np.cross([0, 0, 1], centre)
        east /= np.linalg.norm(east)
        north = np.cross(centre, east)
        turn = np.linspace(0, 6, 9)
        far = np.radians(size) * rng.uniform(0.3, 1, 9)
        v = centre + np.tan(far)[:, None] * (np.cos(turn)[:, None] * east + np.sin(turn)[:, None] * north)
        v /= np.linalg.norm(v, axis=1)[:, None]
        yield [(float(np.degrees(np.arcsin(z))), float(np.degrees(np.arctan2(y, x)))) for x, y, z in v]


def around(rng, places, n):
    p = cells.unit_vectors(*np.array(places).mean(axis=0)[:, None])[0] + rng.normal(size=(n, 3)) * 10 ** rng.uniform(-3, 0, (n, 1))
    return p / np.linalg.norm(p, axis=1)[:, None]


def test_ring_holds_what_it_turns_around():
    rng = np.random.default_rng(8)
    for ring in rings(rng, 60):
        some, v = covers.Polygons([ring]), cells.unit_vectors(*np.array(ring).T)
        p = np.concatenate([around(rng, ring, 60), -around(rng, ring, 20)])
        near = p @ v.mean(axis=0) > 0  # seen from the other side, a ring turns around the opposite points too
        want = [bool(turning(v, x)) and bool(c) for x, c in zip(p, near)]
        assert some.holds(np.zeros(len(p), int), p).tolist() == want


@pytest.mark.parametrize("max_cells", [1, 6, 40])
def test_covers_hold_their_regions(max_cells):
    """Points of discs, wide lines and rings lie in the cover; cells marked as inside hold only such points; many equal one by one."""
    rng = np.random.default_rng(max_cells)
    places = list(rings(rng, 12))
    radii = [float(10 ** rng.uniform(3, 6)) for _ in places]
    for kind, some, single in (
        ("cap", covers.Caps(places, radii), [covers.Cap(*p[0], r) for p, r in zip(places, radii)]),
        ("line", covers.Chains([p[:3] for p in places], radii), [covers.Chain(p[:3], r) for p, r in zip(places, radii)]),
        ("thin", covers.Chains([p[:3] for p in places]), [covers.Chain(p[:3]) for p in places]),
        ("ring", covers.Polygons(places), [covers.Polygon(p) for p in places]),
    ):
        which, ids, inside = covers.cover_many(some, len(places), max_level=14, max_cells=max_cells)
        for k, (place, one) in enumerate(zip(places, single)):
            own = which == k
            assert covers.cover(one, max_level=14, max_cells=max_cells) == ids[own].tolist()
            if kind == "thin":
                v = cells.unit_vectors(*np.array(place[:3]).T)
                t = rng.uniform(size=(200, 1))
                p = np.concatenate([v[:1] * (1 - t) + v[1:2] * t, v[1:2] * (1 - t) + v[2:] * t])
                p, held = p / np.linalg.norm(p, axis=1)[:, None], np.ones(400, bool)
            else:
                p = around(rng, place, 300)
                held = some.holds(np.full(len(p), k), p)
            leaf = cells.leaf_of(p)
            spans = covers.merge_cells(ids[own].tolist())
            found = np.array([any(a <= x <= b for a, b in spans) for x in leaf.tolist()])
            assert not (held & ~found).any()
            sure = covers.merge_cells(ids[own & inside].tolist())
            assert all(h for x, h in zip(leaf.tolist(), held) if any(a <= x <= b for a, b in sure))


def test_point_of_one_vertex():
    assert covers.cover(covers.Chain([(10.0, 20.0)]), max_level=30) == [int(cells.leaves(np.array([10.0]), np.array([20.0]))[0])]


class Stripe:
    """Cells on one face whose level-2 ancestors are every other one."""

    def __init__(self, face):
        self.face = face

    def may_intersect(self, ids):
        wanted = (ids >> np.uint64(61)) == self.face
        deep = cells.levels(ids) >= 2
        return wanted & (~deep | ((cells.raised(ids, 2) >> np.uint64(57)) % 2 == 0))

    def contains(self, ids):
        return cells.levels(ids) >= 2


def test_a_users_regions_cover_a_table(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "region_id string, side int")
    found = covers.cover_regions(rows, max_level=5, max_cells=64, make=lambda r: None if r["side"] is None else Stripe(r["side"])).collect()
    for name, face in (("a", 1), ("b", 4)):
        own = sorted(r.cell % (1 << 64) for r in found if r.region_id == name)
        assert own == covers.cover(Stripe(face), max_level=5, max_cells=64) and len(own) == 8
    assert {r.region_id for r in found} == {"a", "b"} and all(r.inside for r in found)


def test_points_in_regions_of_awkward_tables(spark):
    """Null regions, radii and points, a repeated point, a region over the pole, one of a single point."""
    kinds = "region_id string, kind string, points array<struct<lat:double,lng:double>>, radius_m double"
    regions = spark.createDataFrame([("pole", "cap", [(90.0, 0.0)], 500_000.0), ("all", "cap", [(0.0, 0.0)], 1e9), ("none", None, None, None), ("dot", "polyline", [(1.0, 1.0)], None), ("line", "polyline", [(0.0, -5.0), (0.0, 5.0)], 1000.0), ("ring", "polygon", [(80.0, 0.0), (80.0, 120.0), (80.0, -120.0)], None)], kinds)
    points = spark.createDataFrame([(1, 89.0, 5.0), (1, 89.0, 5.0), (2, 1.0, 1.0), (3, 0.0, 4.99), (4, None, 3.0), (5, float("nan"), 3.0), (6, -89.0, 0.0)], "id int, lat double, lng double")
    got = sorted(map(tuple, covers.points_in_regions(points, regions).collect()))
    assert got == sorted([(1, "pole"), (1, "all"), (1, "ring")] * 2 + [(2, "all"), (2, "dot"), (3, "all"), (3, "line"), (6, "all")])
    empty = regions.where("false")
    assert covers.points_in_regions(points, empty).collect() == []


def test_points_in_cells_equals_containment(spark):
    regions = spark.createDataFrame([("disc", "cap", [(37.4, -122.1)], 800_000.0), ("none", None, None, None)], "region_id string, kind string, points array<struct<lat:double,lng:double>>, radius_m double")
    cover = covers.cover_regions(regions, max_level=10, max_cells=12)
    points = spark.range(3000).select("id", cells.from_lat_lng(30 + F.col("id") % 50 * 0.3, -130 + F.floor(F.col("id") / 50) * 0.3).alias("cell"))
    got = {r.id for r in retrieval.points_in_cells(points, cover).collect()}
    naive = points.join(cover.withColumnRenamed("cell", "c"), cells.contains("c", "cell")).select("id").distinct()
    assert got == {r.id for r in naive.collect()} and got


def test_covering_holds_its_disc(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 5000.0), (0.0, 45.0, 0.0), (-89.0, 3.0, 9e7)], "lat double, lng double, r double")
    got = rows.select(cells.covering("lat", "lng", "r").alias("c"), cells.from_lat_lng("lat", "lng").alias("leaf")).collect()
    for r in got:
        assert any(x.lo % (1 << 64) <= r.leaf % (1 << 64) <= x.hi % (1 << 64) for x in r.c) and len(r.c) <= 9


def test_merge_ranges_unsigned(spark):
    rows = spark.createDataFrame([(1, signed(2**63 - 5), signed(2**63 + 5)), (1, signed(2**63 + 6), signed(2**63 + 9)), (1, 3, 4), (2, signed(2**64 - 1), signed(2**64 - 1)), (2, 0, 0)], "g int, lo long, hi long")
    got = {(r.g, r.lo % (1 << 64), r.hi % (1 << 64)) for r in retrieval.merge_ranges(rows, "g").orderBy(sortable("lo")).collect()}
    assert got == {(1, 3, 4), (1, 2**63 - 5, 2**63 + 9), (2, 0, 0), (2, 2**64 - 1, 2**64 - 1)}


def test_discs_of_a_large_batch():
    """The limit of vertices holds for a region, not for all discs of a batch; batches in stretches give what rows alone give."""
    from orbweave.operators import covers

    rows = [{"kind": "cap", "points": [{"lat": k % 120 - 60.0, "lng": k % 340 - 170.0}], "radius_m": 1000.0 + k} for k in range(covers.MOST_VERTICES + 10)]
    at, ids, inside = covers.covered(rows, max_level=4, max_cells=4)
    assert set(at.tolist()) == set(range(len(rows)))
    for k in (0, covers.TOGETHER - 1, covers.TOGETHER, len(rows) - 1):
        alone = covers.covered([rows[k]], max_level=4, max_cells=4)
        assert (ids[at == k] == alone[1]).all() and (inside[at == k] == alone[2]).all()


def test_points_on_a_meridian_through_a_dented_ring():
    """From the dent to the opposite corner all points are inside, also where two triangles would be put together."""
    from orbweave.functions.cells import unit_vectors
    from orbweave.operators.covers import Polygons

    ring = [(-8.0, -8.0), (9.0, 0.0), (-8.0, 8.0), (-3.0, 0.0)]
    for lat, lng in ((0.0, 0.0), (-47.31, 101.17), (33.33, -66.66)):
        some = Polygons([[(lat + a, lng + b) for a, b in ring]])
        along = lat + np.arange(-299, 900) / 100
        p = unit_vectors(along, np.full(len(along), lng))
        assert some.holds(np.zeros(len(p), np.int64), p).all()
