import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import errors
from orbweave.functions import lsh, markers

SEED = "9e3779b97f4a7c15"


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"e {kind}").select(expr.alias("v")).first().v


def vector(spark, e, expr):
    return one(spark, [float(x) for x in e], "array<float>", expr)


def test_golden_markers(spark):
    assert vector(spark, [1, 2, 3], markers.marker("e")) == f"hk1:8:8:{SEED}:8f0ba155fbabafff"
    assert vector(spark, [3, 2, 1], markers.key("e")) == "90fc5eaef82c2a04"
    assert vector(spark, [1, 2, 3], markers.cell("e")) == [182, 182, 15, 35, 220, 73, 15, 73]
    assert vector(spark, [1, 2, 3], markers.marker("e", markers.Space(3, 10, 1))) == "hk1:3:10:0000000000000001:3c912894"
    assert vector(spark, [0.5, -1, 2e-3], markers.key("e", markers.Space(2, 4))) == "a8"
    assert vector(spark, [0.1, -1.3, 0.8, 2.0], markers.key("e")) == "bc2c18e5c3700fd5"
    drawn = (markers.splitmix64(7, np.arange(384)) % np.uint64(2001)).astype(np.int64)
    v = ((drawn - 1000) / 256).astype(np.float32)
    for scale in (1, 2.0**100, 2.0**-120):
        assert vector(spark, v * np.float32(scale), markers.key("e")) == "35b51b78bface751"


def test_golden_probes(spark):
    got = vector(spark, [1, 2, 3], markers.probes("e", 2, 4))
    assert [(r.lo, r.hi) for r in got] == [(p + "0" * 12, p + "f" * 12) for p in ("8f08", "8f0b", "8ff4", "8ff7")]
    got = vector(spark, [1, 2, 3], markers.probes("e", 1, 2))
    assert [(r.lo, r.hi) for r in got] == [("70" + "0" * 14, "70" + "f" * 14), ("8f" + "0" * 14, "8f" + "f" * 14)]
    assert len(vector(spark, [1, 2, 3], markers.probes("e", 0, 8))) == 1
    assert vector(spark, [1, 2, 3], markers.probes("e", 3, 7)) == vector(spark, [1, 2, 3], markers.probes("e", 3, 4))
    with pytest.raises(errors.OutputLengthMismatch):
        markers.probes("e", 1, 0)


def test_ranges_and_prefixes(spark):
    m = f"hk1:8:8:{SEED}:a0c28ad75ed48ca8"
    head = f"hk1:8:8:{SEED}:"
    for level, lo, hi in ((3, "a0c28a" + "0" * 10, "a0c28a" + "f" * 10), (0, "0" * 16, "f" * 16), (99, "a0c28ad75ed48ca8", "a0c28ad75ed48ca8")):
        r = one(spark, m, "string", markers.key_range("e", level))
        assert (r.lo, r.hi) == (head + lo, head + hi)
    r = one(spark, f"hk1:4:8:{SEED}:deadbeef", "string", markers.key_range("e", 4))
    assert (r.lo[-8:], r.hi[-8:]) == ("dead0000", "deadffff")
    r = one(spark, f"hk1:3:3:{SEED}:1ab", "string", markers.key_range("e", 1))  # 9 bits in 3 digits: cuts inside a digit
    assert (r.lo[-3:], r.hi[-3:]) == ("180", "1bf")
    pairs = [(head + "a0c28ad5a7be0843", 30), (m, 64), ("hk1:8:8:0000000000000001:a0c28ad75ed48ca8", None), ("nothing", None)]
    for other, want in pairs:
        assert one(spark, m, "string", markers.shared_prefix_bits("e", F.lit(other))) == want
    assert one(spark, f"hk1:2:4:{SEED}:8a", "string", markers.marker_cell("e", markers.Space(2, 4))) == [11, 11]


def broken(fields, wrong):
    """Texts a step away from canonical: each field missing, doubled, empty, padded or replaced by each of its wrong forms."""
    for i in range(len(fields)):
        around = lambda *x: ":".join([*fields[:i], *x, *fields[i + 1 :]])  # noqa: B023, E731
        yield from (around(), around(fields[i], fields[i]), around(""), around(" " + fields[i]), around("0" + fields[i]), around(fields[i] + "0" * 40))
        yield from (around(x) for x in wrong.get(i, ()))


def test_strict_parsing(spark):
    good = [f"hk1:{d}:{b}:{SEED}:{'0' * -(-d * b // 4)}" for d, b in ((1, 1), (1, 32), (32, 1), (32, 4), (4, 32), (7, 9), (8, 8))]
    fields = ["hk1", "6", "7", SEED, "3ff00ff00ff"]  # 42 bits in 11 digits, the first below 4
    bad = [*broken(fields, {0: ["hk", "HK1", "hk11"], 1: ["0", "33", "-6", "six"], 2: ["0", "33", "7.0", "8"], 3: [SEED[1:], SEED.replace("e", "E"), "g" * 16], 4: ["4ff00ff00ff", "3FF00ff00ff", "3ff00ff00f", "3ff00ff00f~"]}), "", ":::::"]
    bad += [":".join(fields) + end for end in ("\n", " ", ":")] + ["\t" + ":".join(fields), f"hk1:32:5:{SEED}:{'0' * 40}", f"hk1:5:26:{SEED}:{'0' * 33}"]
    good.append(":".join(fields))
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", markers.is_marker("t").alias("ok"))
    assert {r.t: r.ok for r in rows.collect()} == {t: t in good for t in good + bad}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_invalid_vectors(spark, parts):
    """The same rows are wrong in any partitioning, whichever comes first."""
    data = [(6, [1.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, None), (7, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame(data, "id int, e array<float>").repartition(parts, "id") if parts > 1 else spark.createDataFrame(data, "id int, e array<float>").coalesce(1)
    got = {r.id: (r.m is not None, r.error, r.k is not None) for r in rows.select("id", markers.marker("e", invalid="null", width=2).alias("m"), markers.marker_error("e", width=2).alias("error"), lsh.keys("e", invalid="null", width=2).alias("k")).collect()}
    assert got == {1: (True, None, True), 2: (False, "ZeroVector", False), 3: (False, "NonFiniteValue", False), 4: (False, "NonFiniteValue", False), 5: (False, None, False), 6: (False, "DimensionMismatch", False), 7: (False, "DimensionMismatch", False)}
    with pytest.raises(Exception, match="ZeroVector"):
        rows.where("id < 3").select(markers.marker("e", width=2)).collect()
    # Without a width each row counts by its own.
    own = {r.id: r.k for r in rows.where("id in (1, 6, 7)").select("id", markers.key("e").alias("k")).collect()}
    assert own == {i: vector(spark, e, markers.key("e")) for i, e in data if i in (1, 6, 7)}


def test_probe_count_has_a_limit():
    for n in (0, lsh.MOST_PROBES + 1):
        with pytest.raises(errors.OutputLengthMismatch):
            lsh.probes("e", n)


def test_hash_keys(spark):
    t = lsh.Tables(3, 4)
    assert vector(spark, [1, 2, 3, -1], lsh.marker(lsh.keys("e", t), t)) == f"hk2:3:4:{SEED}:7.1.a"
    assert vector(spark, [1, 2, 3, -1], lsh.probes("e", 3, t)) == [[7, 3, 15], [1, 0, 5], [10, 14, 11]]
    small = lsh.Tables(2, 6)
    assert vector(spark, [0.5, -0.2, 0.1], lsh.marker(lsh.keys("e", small), small)).endswith(":3f.23")
    v = np.random.default_rng(1).normal(size=32)
    up, down = vector(spark, v, lsh.keys("e")), vector(spark, -4 * v, lsh.keys("e"))
    assert [a ^ b for a, b in zip(up, down)] == [255] * 16
    found = lsh.probe_keys(np.array([[0.9, -0.1, 0.5, -0.05]]), np.array([0b0101], np.uint64), 16)[0].tolist()
    assert found[:3] == [0b0101, 0b1101, 0b0111] and len(set(found)) == 16
    good = [f"hk2:1:1:{SEED}:1", f"hk2:2:64:{SEED}:{'f' * 16}.{'0' * 16}", f"hk2:2:9:{SEED}:1ff.0a0"]
    fields = ["hk2", "2", "9", SEED, "1ff.0a0"]
    bad = [*broken(fields, {0: ["hk1", "Hk2"], 1: ["0", "1", "3", "2000", "two"], 2: ["0", "65", "13", "9e0"], 3: [SEED[:-1], SEED.upper()], 4: ["2ff.0a0", "1FF.0a0", "1ff", "1ff.0a0.000", "1ff..0a0", "1ff.a0", "1ff,0a0", ".1ff.0a0"]}), ""]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", lsh.parse("t").alias("p"))
    got = {r.t: r.p for r in rows.collect()}
    assert {t: p is not None for t, p in got.items()} == {t: t in good for t in good + bad}
    assert (got[good[2]].tables, got[good[2]].bits, got[good[2]]["keys"]) == (2, 9, [0x1FF, 0x0A0])


def test_near_vectors_share_longer_prefixes_and_probes_find_more(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    near = base + 0.2 * rng.normal(size=base.shape)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(base, near))], "id int, a array<float>, b array<float>")
    kept = rows.select(markers.probes("a", 1, 1).alias("one"), markers.probes("a", 1, 16).alias("many"), markers.key("b").alias("key"))
    hit = lambda c: F.avg(F.when(F.exists(c, lambda r: F.col("key").between(r["lo"], r["hi"])), 1.0).otherwise(0.0))
    one_, many = kept.agg(hit("one"), hit("many")).first()
    assert many >= 1.25 * one_ and many > 0.8


def test_collision_rate_follows_the_angle(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=64)
    b = a + 0.5 * rng.normal(size=64)
    theta = np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    t = lsh.Tables(1024, 4)
    p = (1 - theta / np.pi) ** 4
    same = sum(x == y for x, y in zip(vector(spark, a, lsh.keys("e", t)), vector(spark, b, lsh.keys("e", t))))
    assert abs(same / 1024 - p) < 4 * (p * (1 - p) / 1024) ** 0.5
