import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from orbweave import errors
from orbweave.functions import curve

U = np.uint64


def bitwise(bits, x, y):
    """The definition, a level at a time."""
    h = swap = flip = 0
    for k in reversed(range(bits)):
        bx, by = x >> k & 1, y >> k & 1
        if swap:
            bx, by = by, bx
        rx, ry = bx ^ flip, by ^ flip
        h = h << 2 | rx << 1 | rx ^ ry
        if not ry:
            swap ^= 1
            flip ^= rx
    return h


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5])
def test_small_spaces_are_walks_through_every_cell(bits):
    n = 1 << bits
    x, y = (a.ravel().astype(U) for a in np.meshgrid(np.arange(n), np.arange(n)))
    h = curve.encode2_array(bits, x, y)
    assert sorted(h.tolist()) == list(range(n * n))
    assert h.tolist() == [bitwise(bits, int(a), int(b)) for a, b in zip(x, y)]
    px, py = curve.decode2_array(bits, np.arange(n * n).astype(U))
    assert (np.abs(np.diff(px.astype(int))) + np.abs(np.diff(py.astype(int))) == 1).all()
    assert (px[0], py[0], px[-1], py[-1]) == (0, 0, n - 1, 0)


@pytest.mark.parametrize("bits", [6, 13, 16, 31, 32])
def test_large_orders_round_trip_and_agree_with_n_dimensions(bits):
    rng = np.random.default_rng(bits)
    x, y = rng.integers(0, 1 << bits, (2, 500), dtype=U)
    h = curve.encode2_array(bits, x, y)
    assert h[:50].tolist() == [bitwise(bits, int(a), int(b)) for a, b in zip(x[:50], y[:50])]
    assert all((a == b).all() for a, b in zip(curve.decode2_array(bits, h), (x, y)))
    assert (curve.encode_array(np.stack([x, y], 1), bits)[1] == h).all()


def test_known_values(spark):
    row = spark.range(1).select(curve.encode2(F.lit(12345), F.lit(54321), 16).alias("h"), curve.decode2(F.lit(1555040834), 16).alias("p"), curve.encode2(F.lit(1), F.lit(1), 1).alias("two")).first()
    assert (row.h, tuple(row.p), row.two) == (1555040834, (12345, 54321), 2)


@pytest.mark.parametrize("dims,bits", [(1, 8), (3, 4), (4, 3)])
def test_n_dimensional_walks(spark, dims, bits):
    walk = curve.curve_walk(spark, dims, bits, 0, 1 << dims * bits)
    before = F.lag("point").over(Window.orderBy("index"))
    step = F.aggregate(F.zip_with("point", "before", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    rows = walk.withColumn("before", before).select("index", "point", step.alias("step"), curve.encode("point", dims, bits).alias("back")).collect()
    assert all(r.back == r["index"] for r in rows)
    assert all(r.step == 1 for r in rows if r["index"])
    assert len({tuple(r.point) for r in rows}) == 1 << dims * bits


def test_errors_and_nulls(spark):
    for bits in (0, 33):
        with pytest.raises(errors.OrderOutOfRange):
            curve.encode2("x", "y", bits)
    for dims, bits, error in ((0, 8, errors.DimensionsOutOfRange), (33, 1, errors.DimensionsOutOfRange), (16, 9, errors.OrderOutOfRange), (5, 32, errors.OrderOutOfRange)):
        with pytest.raises(error):
            curve.check_space(dims, bits)
    rows = spark.createDataFrame([(1, 2), (None, 2), (16, 0)], "x long, y long")
    assert [r.h for r in rows.select(curve.encode2("x", "y", 4, invalid="null").alias("h")).collect()] == [bitwise(4, 1, 2), None, None]
    assert [r.h for r in rows.select(curve.encode2("x", "y", 4).alias("h")).collect()] == [bitwise(4, 1, 2), None, bitwise(4, 0, 0)]
    for expr in (curve.encode2("x", "y", 4, invalid="raise"), curve.decode2(F.col("x") * 100, 2, invalid="raise"), curve.encode(F.array("x", "y"), 2, 4)):
        with pytest.raises(Exception, match="OutOfRange"):
            rows.where("x is not null").select(expr).collect()
    with pytest.raises(errors.IndexOutOfRange):
        curve.curve_walk(spark, 3, 2, 60, 5)


def test_fold_and_kernel_agree(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 65536).alias("x"), (F.col("id") * 104729 % 65536).alias("y"))
    assert rows.where(curve.encode2_expr("x", "y", 16) != curve.encode2("x", "y", 16)).count() == 0
