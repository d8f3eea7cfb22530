"""Exact search by bounds, the forest, and walks, against plain forms of the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import curve, lsh
from orbweave.operators import forest, nearest, retrieval
from orbweave.plans.queries import QUERIES
from tests.conftest import SMALL


def rows(frame):
    return sorted(map(tuple, frame.select("query_id", "id", "cosine", "rank").collect()), key=repr)


def table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")


def test_pruned_equals_exact_on_ties_zeros_and_nulls(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(60)] + [[0.0] * 4, None]
    data = table(spark, vectors)
    queries = data.where("id % 7 = 0 or id >= 60").withColumnRenamed("id", "query_id")
    for k in (1, 10, 100):
        assert rows(nearest.pruned_topk(queries, data, k=k).rows) == rows(retrieval.exact_topk(queries, data, k=k))


def test_pruned_share_falls_as_the_table_grows(spark, monkeypatch):
    """Forty clusters: the same rows as all pairs, from ever fewer of them."""
    for name, value in (("BLOCK", 32), ("PER_CELL", 32), ("GROUP", 16)):
        monkeypatch.setattr(nearest, name, value)
    rng, shares = np.random.default_rng(5), []
    centres = rng.normal(size=(40, 16))
    for n in (500, 4000):
        data = table(spark, [[float(x) for x in centres[i % 40] + rng.normal(size=16) / 30] for i in range(n)])
        queries = data.where("id % 20 = 0").withColumnRenamed("id", "query_id")
        found = nearest.pruned_topk(queries, data, k=10)
        assert rows(found.rows) == rows(retrieval.exact_topk(queries, data, k=10))
        shares.append(found.share())
    assert shares[0] < 0.5 and shares[1] < shares[0] / 2


def test_pruned_refuses_odd_vectors(spark):
    data = table(spark, [[1.0, 2.0], [1.0]])
    with pytest.raises(Exception, match="one width"):
        nearest.pruned_topk(data.withColumnRenamed("id", "query_id"), data, k=1).rows.collect()
    empty = data.where("false")
    assert nearest.pruned_topk(empty.withColumnRenamed("id", "query_id"), empty, k=1).rows.collect() == []


@pytest.mark.parametrize("reach", [1, 3])
def test_forest_takes_the_rows_beside(spark, reach):
    """Keys of few bits, so that many are equal, and trees that span partitions."""
    rng = np.random.default_rng(2)
    space = lsh.Tables(3, 5)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(200)] + [None, [0.0] * 6]
    data = table(spark, vectors)
    queries = data.where("id % 9 = 0").select((F.col("id") + 1000).alias("query_id"), "embedding")
    keys = lsh.keys_of(lsh.margins_of(np.array(vectors[:200], np.float32), space)).astype(np.int64)
    want = set()
    for q in range(0, 200, 9):
        for t in range(3):
            order = sorted(range(200), key=lambda i: (keys[i, t], i))
            place = sum(int(keys[i, t] < keys[q, t]) for i in range(200))
            want |= {(q + 1000, i) for i in order[max(0, place - reach) : place + reach]}
    found = [tuple(r) for r in forest.candidates(queries, data, reach=reach, space=space).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_forest_finds_nine_of_ten_neighbours(spark):
    """On the table of the middle size, candidates per query being bounded by 2 * 6 * 128."""
    found = QUERIES["hk2_forest_recall"](spark, SMALL.replace("0.001", "0.1")).first()
    assert found.recall >= 0.9


SPACES = [(3, 10), (16, 8), (2, 32), (4, 32), (32, 4), (32, 1), (1, 32), (2, 1), (7, 9), (20, 6), (8, 16), (17, 7)]


@pytest.mark.parametrize("dims,bits", SPACES)
def test_walk_equals_decoding(dims, bits):
    rng = np.random.default_rng(dims * bits)
    for most in (100_000, 3000, 1):
        n = min(most, 1 << dims * bits)
        start = int(rng.random() * ((1 << dims * bits) - n))
        index = [start + i for i in range(n)]
        high, low = (np.array([v >> s & (1 << 64) - 1 for v in index], np.uint64) for s in (64, 0))
        assert np.array_equal(curve.walk_array(start, n, dims, bits).T, curve.decode_array(high, low, dims, bits).astype(np.int64))


def test_walk_source_spans_tasks(spark):
    walk = curve.curve_walk(spark, 3, 10, 12345, 5000)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW w USING curve_walk OPTIONS (dims 3, bits 10, start 12345, count 5000, rows_per_task 700)")
    cut = spark.table("w")
    assert cut.rdd.getNumPartitions() == 8
    assert sorted(cut.collect()) == sorted(walk.collect())
    decoded = walk.select("index", "point", curve.decode("index", 3, 10).alias("p"))
    assert decoded.where("point <> p").count() == 0 and walk.count() == 5000


def test_walk_source_of_a_wide_space(spark):
    start = (1 << 64) - 3
    walk = curve.curve_walk(spark, 16, 8, start, 10)
    assert [r["index"] for r in walk.collect()] == [f"{start + i:032x}" for i in range(10)]
    assert walk.where(~(curve.decode("index", 16, 8) == F.col("point"))).count() == 0


def test_nothing_to_walk(spark):
    assert curve.curve_walk(spark, 3, 10, 5, 0).collect() == []


def test_bucket_pairs_come_once_and_only_keys_are_exchanged(spark, monkeypatch):
    """Over several blocks, with a hot bucket, repeated ids, nulls and text ids, against plain loops."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 40)
    monkeypatch.setattr(retrieval, "DATA_BLOCK", 70)
    monkeypatch.setattr(retrieval, "SCORED", 7)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 9, (200, 3))
    keys[:60, 1] = 4
    rows = [(f"d{i % 190}", k) for i, k in enumerate(keys.tolist())] + [("none", None)]
    asked = [(i % 95, k) for i, k in enumerate(rng.integers(0, 9, (100, 3)).tolist())] + [(999, None)]
    data, queries = spark.createDataFrame(rows, "id string, keys array<long>"), spark.createDataFrame(asked, "query_id int, keys array<long>")
    found = retrieval.bucket_candidates(queries, data)
    want = {(q, i) for q, a in asked for i, k in rows if a and k and any(x == y for x, y in zip(a, k))}
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert retrieval.bucket_candidates(queries.where("false"), data).collect() == [] == retrieval.bucket_candidates(queries, data.where("false")).collect()

    e = rng.normal(size=(200, 5)).round(3)
    e[3] = 0
    vectors = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(e.tolist(), keys.tolist()))], "id long, embedding array<float>, keys array<long>")
    some = vectors.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    pairs = retrieval.bucket_candidates(some.select("query_id", "keys"), vectors.select("id", "keys"))
    want = retrieval.rerank(pairs, some.select("query_id", "embedding"), vectors.select("id", "embedding"), k=10)
    cut = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", F.coalesce(F.round("cosine", 9), F.lit(9.0))).collect())
    assert cut(retrieval.bucket_topk(some, vectors, k=10)) == cut(want)
