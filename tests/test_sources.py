import json

import pytest
from pyspark.sql import functions as F

from orbweave.functions import markers
from orbweave.operators import layout
from orbweave.sources import lines
from orbweave.streaming.markers import keep_stream, kept, stream_markers

SEED = "9e3779b97f4a7c15"


def written(tmp_path, text):
    (tmp_path / "in.jsonl").write_text(text)
    return str(tmp_path)


def test_embedding_lines(spark, tmp_path):
    """Objects and arrays, blanks around and between them; markers as of the vectors themselves."""
    vectors = [[0.25, -4.0, 1.5, 8.0], [-1.0, 2.5, 0.0, 3.0], [6.0, 6.0, -0.5, 1.0]]
    path = written(tmp_path, f'\n\t{{"title":"peak","id":"row A","embedding":{vectors[0]}}}\r\n{{"embedding":{vectors[1]},"id":-7}} \t\n\n{vectors[2]}')
    rows = lines.read_embeddings(spark, path, width=4, strict=True).withColumn("marker", markers.marker("embedding")).coalesce(1)
    direct = spark.createDataFrame(list(enumerate(vectors)), "k int, e array<float>").select("k", markers.marker("e").alias("m"))
    m = [r.m for r in direct.orderBy("k").collect()]
    assert len(set(m)) == 3 and all(x.startswith(f"hk1:8:8:{SEED}:") for x in m)
    assert [r.value for r in lines.marker_lines(rows).collect()] == [f"row A\t{m[0]}", f"-7\t{m[1]}", m[2]]
    assert [json.loads(r.value) for r in lines.json_lines(rows, "marker").collect()] == [{"id": "row A", "marker": m[0]}, {"id": -7, "marker": m[1]}, {"marker": m[2]}]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files cut into many splits: numbers and errors are those of the file."""
    for name, n in (("a", 3000), ("b", 1), ("c", 700), ("d", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i + 1}{' ' * (i % 40)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [(r.file[-5:-4], r.line, int(r.value)) for r in rows.collect()]
        assert len(got) == 3701 and all(line == value for _, line, value in got) and {f for f, _, _ in got} == set("abc")
        (tmp_path / "b.txt").write_text("[1,2]\n" * 900 + "[3]\n" + "[1,2]\n" * 900)
        bad = lines.read_embeddings(spark, str(tmp_path / "b.txt"), width=2, numbered=True).where("error is not null").collect()
        assert [(r.line, r.error.rpartition("b.txt")[2]) for r in bad] == [(901, ", line 901: 1 numbers where 2 are due")]
        with pytest.raises(Exception, match="b.txt, line 901: 1 numbers"):
            lines.read_embeddings(spark, str(tmp_path / "b.txt"), width=2, numbered=True, strict=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_lines(spark, tmp_path):
    path = written(tmp_path, '[1,2]\n[1e400,1,1]\n["a"]\n{"x":1}\n[]\n[0,0,0]\n[1,2,3]\n')
    got = [r.error for r in lines.read_embeddings(spark, path, width=3).coalesce(1).collect()]
    wrong = "no array of numbers found"
    assert got == ["2 numbers where 3 are due", "NonFiniteValue", wrong, wrong, "the array holds no number", "ZeroVector", None]
    with pytest.raises(Exception, match="over the limit of 4 bytes: 5"):
        lines.read_embeddings(spark, path, max_line=4, strict=True).collect()


def test_bad_ids_in_text_output(spark, tmp_path):
    for text, message in (('{"id":"a\\tb","embedding":[1]}', "tab or line end"), ('{"id":{},"embedding":[1]}', "texts and numbers")):
        rows = lines.read_embeddings(spark, written(tmp_path, text)).withColumn("marker", markers.marker("embedding"))
        with pytest.raises(Exception, match=message):
            lines.marker_lines(rows).collect()


def test_point_lines(spark, tmp_path):
    path = written(tmp_path, "10 20\n\n -3.5\t4e1 \n1 2 3\nx y\n")
    assert [(r.lat, r.lng, r.error) for r in lines.read_points(spark, path).coalesce(1).collect()][:2] == [(10.0, 20.0, None), (-3.5, 40.0, None)]
    assert lines.read_points(spark, path).where("error is not null").count() == 2


def test_regions_from_point_lines(spark, tmp_path):
    from orbweave.operators import covers

    (tmp_path / "a.txt").write_text("10 10\n\n10.2 10.3\r\n 12\t11 \n")
    rows = lines.read_regions(spark, str(tmp_path), "polyline")
    assert [[(p.lat, p.lng) for p in r.points] for r in rows.collect()] == [[(10.0, 10.0), (10.2, 10.3), (12.0, 11.0)]]
    found = {r.cell % (1 << 64) for r in covers.cover_regions(rows, max_level=12, max_cells=8).collect()}
    assert found == set(covers.cover(covers.Chain([(10, 10), (10.2, 10.3), (12, 11)]), max_level=12, max_cells=8))
    (tmp_path / "a.txt").write_text("10 10\n1 2 3\n")
    with pytest.raises(Exception, match="line 2: not two numbers"):
        lines.read_regions(spark, str(tmp_path), "polyline").collect()
    (tmp_path / "a.txt").write_text("\n\n")
    with pytest.raises(Exception, match="holds no point"):
        lines.read_regions(spark, str(tmp_path), "polygon").collect()


def test_hash_and_range_lines(spark, tmp_path):
    from orbweave.functions import lsh

    path = written(tmp_path, '{"id":"n","embedding":[1,2,3,-1]}\n[1,2,3,-1]\n')
    rows = lines.read_embeddings(spark, path).coalesce(1)
    t = lsh.Tables(3, 4)
    got = [json.loads(r.value) for r in lines.hash_lines(rows, n_probes=3, space=t).collect()]
    body = {"marker": f"hk2:3:4:{SEED}:7.1.a", "keys": ["7", "1", "a"], "probes": [["7", "3", "f"], ["1", "0", "5"], ["a", "e", "b"]]}
    assert got == [{"id": "n"} | body, body]
    assert "probes" not in json.loads(lines.hash_lines(rows, space=t).first().value)
    ranges = spark.createDataFrame([(-1, -1), (1, 5)], "lo long, hi long").coalesce(1)
    assert [r.value for r in lines.range_lines(ranges).collect()] == [f"{2**64 - 1} {2**64 - 1}", "1 5"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":1,"embedding":[1,2,3]}\n[3,2,1]\n')
    (tmp_path / "in" / "b.jsonl").write_text("[0,0,0]\n")
    query = stream_markers(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.id, r.marker, r.error) for r in spark.table("marked").collect()}
    assert got == {("1", f"hk1:8:8:{SEED}:8f0ba155fbabafff", None), (None, f"hk1:8:8:{SEED}:90fc5eaef82c2a04", None), (None, None, "ZeroVector")}


def test_clustered_files_prune_by_key(spark, tmp_path):
    rows = spark.range(2000).select("id", markers.key(F.array(F.col("id") * 1.0, F.lit(3.0), F.sin("id"))).alias("key"))
    layout.cluster_by(rows, "key", partitions=4).write.parquet(str(tmp_path / "t"))
    edges = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(edges, edges[1:]))


def test_a_stopped_stream_goes_on(spark, tmp_path, monkeypatch):
    """The second batch dies after its good rows, before its mark: nothing of it shows, the first stays, and a new start equals the batch result."""
    from pyspark.sql import DataFrameWriter

    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    text = lambda k: "".join(f'{{"id":{10 * k + i},"embedding":[{i},{k},3]}}\n' for i in range(4)) + f"[{k}]\n"

    def run():
        query = keep_stream(stream_markers(spark, str(source), width=3), out, state, availableNow=True)
        query.awaitTermination()

    (source / "0.jsonl").write_text(text(0))
    run()
    first = sorted(map(tuple, kept(spark, out).collect()))
    assert len(first) == 4 and kept(spark, out, "bad").count() == 1
    (source / "1.jsonl").write_text(text(1))
    write = DataFrameWriter.parquet

    def dies(self, path, *args, **kw):
        if "/marks/batch=1" in path:
            raise RuntimeError("power cut")
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="power cut"):
        run()
    monkeypatch.undo()
    assert sorted(map(tuple, kept(spark, out).collect())) == first
    run()
    want = lines.read_embeddings(spark, str(source), width=3)
    good = want.where("error is null").select("id", "id_json", "kind", markers.marker("embedding").alias("marker"))
    assert sorted(map(tuple, kept(spark, out).collect())) == sorted(map(tuple, good.collect()))
    assert kept(spark, out, "bad").count() == want.where("error is not null").count() == 2
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/marks").select("batch", "good", "bad").collect()) == [(0, 4, 1), (1, 4, 1)]
