import duckdb
import numpy as np
import pytest

from orbweave.operators import retrieval
from orbweave.plans.oracles import ORACLES
from orbweave.plans.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part", "supplier", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(map(tuple, (tuple(r[c] for c in columns) for r in frame.collect())), key=repr)
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
        assert got == want


def nearest():
    """Brute force: the ten greatest cosines of each query."""
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    e /= np.linalg.norm(e, axis=1)[:, None]
    return {int(ids[i]): {(int(ids[j])) for j in np.lexsort((ids, -np.round(e @ e[i], 12)))[:10]} for i in np.flatnonzero(ids % 20 == 0)}


def test_hk1_topk_finds_the_nearest(spark):
    found = {}
    for r in QUERIES["hk1_topk"](spark, SMALL).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert found == nearest()


def test_exact_topk_over_several_blocks(spark, monkeypatch):
    """Equal to rerank over all pairs, ties, zeros and nulls included."""
    for name, value in (("DATA_BLOCK", 16), ("QUERY_BLOCK", 4), ("SCORED", 3)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(60)] + [[0.0] * 4, None]
    data = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    queries = data.where("id % 7 = 0 or id >= 60").withColumnRenamed("id", "query_id")
    held = data.where("embedding is not null")
    want = retrieval.rerank(queries.where("embedding is not null").select("query_id").crossJoin(held.select("id")), queries, held, k=10)
    assert sorted(map(tuple, retrieval.exact_topk(queries, data, k=10).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_written_filter_reaches_the_scan(spark):
    plan = QUERIES["hk1_written_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(marker" in plan
