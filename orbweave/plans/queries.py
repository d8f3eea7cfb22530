"""The queries over the star-schema and embedding tables, one per operator of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import cells, curve, lsh, markers, sql
from orbweave.functions.unsigned import hex16
from orbweave.operators import checks, covers, forest, layout, nearest, ranges, retrieval
from orbweave.sources import lines
from orbweave.streaming.markers import keep_stream, kept, stream_markers
from orbweave.workspace import Workspace

LINE = ("l_orderkey", "l_linenumber")
ORDER = 16
SMALL = markers.Space(3, 10, 1)
SPACE = markers.Space()
TABLES = lsh.Tables(16, 8)
#: Trees of the forest and rows taken on either side in each.
FOREST, REACH = lsh.Tables(128, 24), 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xy(spark, sf_dir) -> DataFrame:
    low = F.lit((1 << ORDER) - 1)
    line = _table(spark, sf_dir, "lineitem")
    return line.select(*LINE, F.col("l_partkey").bitwiseAND(low).alias("x"), F.col("l_suppkey").bitwiseAND(low).alias("y"))


def curve2d_encode(spark, sf_dir):
    return _xy(spark, sf_dir).select(*LINE, curve.encode2("x", "y", ORDER, invalid="raise").alias("h"))


def curve2d_encode_fold(spark, sf_dir):
    return _xy(spark, sf_dir).select(*LINE, curve.encode2_expr("x", "y", ORDER).alias("h"))


def _orders_index(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % (1 << 32)).alias("h"))


def curve2d_decode(spark, sf_dir):
    return _orders_index(spark, sf_dir).withColumn("p", curve.decode2("h", ORDER, invalid="raise")).select("o_orderkey", "p.x", "p.y")


def curve2d_roundtrip(spark, sf_dir):
    p = _orders_index(spark, sf_dir).withColumn("p", curve.decode2("h", ORDER))
    return p.select("o_orderkey", "h", (curve.encode2("p.x", "p.y", ORDER) == F.col("h")).alias("same"))


def curve2d_order32(spark, sf_dir):
    x = (F.col("o_orderkey") * 2654435761) % (1 << 32)
    y = (F.col("o_custkey") * 40503 + F.col("o_orderkey")) * 65537 % (1 << 32)
    return _table(spark, sf_dir, "orders").select("o_orderkey", hex16(curve.encode2(x, y, 32)).alias("h"))


def curve_clustered_sort(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", curve.encode2(F.col("p_partkey") % 65536, F.col("p_size"), ORDER).alias("h"))
    return layout.cluster_by(part, "h", "p_partkey")


def curve_density(spark, sf_dir):
    h = _xy(spark, sf_dir).select(curve.encode2("x", "y", ORDER).alias("h"))
    return layout.density(h, F.shiftright("h", 16))


def _point(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    return line.select(*LINE, F.array(F.col("l_orderkey") % 1024, F.col("l_partkey") % 1024, F.col("l_suppkey") % 1024).alias("p"))


def curvend_encode(spark, sf_dir):
    return _point(spark, sf_dir).select(*LINE, curve.encode("p", 3, 10).alias("h"))


def curvend_decode(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    p = curve.decode((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")) % (1 << 30), 3, 10)
    return line.select(*LINE, p.alias("p")).select(*LINE, *(F.col("p")[i].alias(f"x{i}") for i in range(3)))


def curvend_wide(spark, sf_dir):
    """16 axes of 8 bits: 128-bit indexes as hex, and back."""
    axes = F.array(*[(F.col("c_custkey") * (2 * i + 1) + 37 * i) % 256 for i in range(16)])
    rows = _table(spark, sf_dir, "customer").select("c_custkey", axes.alias("p"))
    rows = rows.select("c_custkey", "p", curve.encode("p", 16, 8).alias("h"))
    return rows.select("c_custkey", "h", (curve.decode("h", 16, 8) == F.col("p")).alias("same"))


def curve_walk(spark, sf_dir):
    n = _table(spark, sf_dir, "supplier").count() * 10
    walk = curve.curve_walk(spark, 3, 10, 12345, n)
    return walk.select("index", *(F.col("point")[i].alias(f"x{i}") for i in range(3)))


def _embeddings(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def hk1_cell(spark, sf_dir):
    c = _embeddings(spark, sf_dir).select("vec_id", markers.cell("embedding", SPACE).alias("c"))
    return c.select("vec_id", *(F.col("c")[i].alias(f"x{i}") for i in range(8)))


def hk1_marker(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", markers.marker("embedding", SPACE).alias("marker"))


def hk1_range(spark, sf_dir):
    r = hk1_marker(spark, sf_dir).select("vec_id", markers.key_range("marker", 3).alias("r"))
    return r.select("vec_id", "r.lo", "r.hi")


def hk1_shared_prefix(spark, sf_dir):
    m = hk1_marker(spark, sf_dir)
    other = m.select((F.col("vec_id") + 1).alias("vec_id"), F.col("marker").alias("before"))
    return m.join(other, "vec_id").select("vec_id", markers.shared_prefix_bits("marker", "before").cast("int").alias("bits"))


def hk1_parse(spark, sf_dir):
    """Canonical texts parse; upper case, cut and padded ones don't."""
    forms = F.array("marker", F.upper("marker"), F.concat("marker", F.lit(":")), F.expr("left(marker, length(marker) - 1)"), F.replace("marker", F.lit("hk1:8"), F.lit("hk1:08")))
    rows = hk1_marker(spark, sf_dir).select("vec_id", F.posexplode(forms).alias("form", "text"))
    return rows.select("vec_id", "form", markers.is_marker("text").alias("valid"), markers.parse("text")["key"].alias("key"))


def hk1_marker_cell(spark, sf_dir):
    c = hk1_marker(spark, sf_dir).select("vec_id", markers.marker_cell("marker", SPACE).alias("c"))
    return c.select("vec_id", *(F.col("c")[i].alias(f"x{i}") for i in range(8)))


def _asked(spark, sf_dir):
    """The query set of searches: every row whose id is divisible by 20, against all rows."""
    return _embeddings(spark, sf_dir).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def hk1_probe_ranges(spark, sf_dir):
    r = _embeddings(spark, sf_dir).select("vec_id", F.posexplode(markers.probes("embedding", 1, 8, SPACE)).alias("at", "r"))
    return r.select("vec_id", "at", "r.lo", "r.hi")


def hk1_candidates(spark, sf_dir):
    data = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), markers.key("embedding", SPACE).alias("key"))
    return retrieval.probe_candidates(_asked(spark, sf_dir), data, level=1, n=4, space=SPACE)


def hk1_topk(spark, sf_dir):
    """The ten nearest of all rows: the few cells of ``hk1_candidates`` hold too few of them."""
    data = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    found = retrieval.exact_topk(_asked(spark, sf_dir), data, k=10)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def hk2_marker(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", lsh.marker(lsh.keys("embedding", TABLES), TABLES).alias("marker"))


def hk2_parse(spark, sf_dir):
    p = hk2_marker(spark, sf_dir).select("vec_id", lsh.parse("marker").alias("p"))
    return p.select("vec_id", "p.tables", "p.bits", "p.seed", F.posexplode("p.keys").alias("t", "key"))


def _keys(spark, sf_dir, name="id"):
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias(name), lsh.keys("embedding", TABLES).alias("keys"))


def hk2_bucket_sizes(spark, sf_dir):
    return retrieval.bucket_sizes(_keys(spark, sf_dir))


def hk2_collisions(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("query_id", lsh.keys("embedding", TABLES).alias("keys"))
    return retrieval.bucket_candidates(asked, _keys(spark, sf_dir))


def hk2_multiprobe(spark, sf_dir):
    return retrieval.multiprobe_candidates(_asked(spark, sf_dir), _keys(spark, sf_dir), n=4, space=TABLES)


def hk2_topk(spark, sf_dir):
    asked, data = (df.withColumn("keys", lsh.keys("embedding", TABLES)) for df in (_asked(spark, sf_dir), _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")))
    found = retrieval.bucket_topk(asked, data, k=10)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _leaves(spark, sf_dir):
    lat = (F.col("c_custkey") * 7919 % 17901) / F.lit(100.0) - 89.5
    lng = (F.col("c_custkey") * 104729 % 36000) / F.lit(100.0) - 180.0
    return _table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lng.alias("lng"), cells.from_lat_lng(lat, lng).alias("cell"))


def s2_leaf(spark, sf_dir):
    c = F.col("cell")
    return _leaves(spark, sf_dir).select("c_custkey", hex16(c).alias("id"), cells.token(c).alias("token"), cells.face(c).alias("face"), cells.pos(c).alias("pos"), cells.level(c).alias("level"), cells.valid(c).alias("valid"))


def s2_hierarchy(spark, sf_dir):
    up = _leaves(spark, sf_dir).select("c_custkey", cells.parent("cell", 12).alias("p"), "cell")
    r = cells.id_range("p")
    return up.select("c_custkey", cells.token("p").alias("parent"), cells.level("p").alias("level"), hex16(r["lo"]).alias("lo"), hex16(r["hi"]).alias("hi"), cells.contains("p", "cell").alias("holds"), F.posexplode(F.transform(cells.children("p"), cells.token)).alias("k", "child"))


def s2_density(spark, sf_dir):
    found = layout.density(_leaves(spark, sf_dir), cells.parent("cell", 4))
    return found.select(cells.token("cell").alias("cell"), "n")


def s2_token_roundtrip(spark, sf_dir):
    t = _leaves(spark, sf_dir).select("c_custkey", "cell", cells.token(cells.parent("cell", 9)).alias("token"))
    return t.select("c_custkey", (cells.from_token(F.upper("token")) == cells.parent("cell", 9)).alias("same"), cells.from_token(F.concat("token", F.lit("g"))).isNull().alias("refused"))


def s2_neighbours(spark, sf_dir):
    n = _leaves(spark, sf_dir).select("c_custkey", F.posexplode(cells.edge_neighbours(cells.parent("cell", 10))).alias("edge", "c"))
    return n.select("c_custkey", "edge", cells.token("c").alias("token"))


def s2_center(spark, sf_dir):
    c = _leaves(spark, sf_dir).select("c_custkey", cells.center(cells.parent("cell", 10)).alias("p"))
    return c.select("c_custkey", F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


def s2_covering(spark, sf_dir):
    r = _leaves(spark, sf_dir).select("c_custkey", F.posexplode(cells.covering("lat", "lng", F.col("c_custkey") * 10.0)).alias("at", "r"))
    return r.select("c_custkey", "at", hex16("r.lo").alias("lo"), hex16("r.hi").alias("hi"))


def _regions(spark, sf_dir):
    """A region per supplier: a disc, a line of three points with a width, or a ring of four with a dent."""
    k = F.col("s_suppkey")
    lat, lng = (k * 7919 % 12001) / F.lit(100.0) - 60.0, (k * 104729 % 34000) / F.lit(100.0) - 170.0
    at = lambda *steps: F.array(*[F.struct((lat + x).alias("lat"), (lng + y).alias("lng")) for x, y in steps])
    kind = F.element_at(F.array(*map(F.lit, ("cap", "polyline", "polygon"))), (k % 3 + 1).cast("int"))
    points = F.when(k % 3 == 0, at((0.0, 0.0))).when(k % 3 == 1, at((0.0, 0.0), (6.0, 8.0), (2.0, 15.0))).otherwise(at((-8.0, -8.0), (9.0, 0.0), (-8.0, 8.0), (-3.0, 0.0)))
    radius = F.when(k % 3 == 0, 200000.0 + k % 20 * 50000).when(k % 3 == 1, 150000.0 + k % 10 * 20000)
    return _table(spark, sf_dir, "supplier").select(k.alias("region_id"), kind.alias("kind"), points.alias("points"), radius.alias("radius_m"))


def _cover(spark, sf_dir):
    return covers.cover_regions(_regions(spark, sf_dir).where("kind = 'cap'"), max_level=5, max_cells=2048)


def s2_cover(spark, sf_dir):
    """The discs of suppliers by cells of level 5 and coarser ones inside."""
    return _cover(spark, sf_dir).select("region_id", cells.token("cell").alias("token"), cells.level("cell").alias("level"), "inside")


def s2_points_in_cover(spark, sf_dir):
    return retrieval.points_in_cells(_leaves(spark, sf_dir).select(F.col("c_custkey").alias("id"), "cell"), _cover(spark, sf_dir))


def s2_points_in_regions(spark, sf_dir):
    """Customers within discs, near lines and in rings of suppliers: exact, by covers first."""
    points = _leaves(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lat", "lng")
    return covers.points_in_regions(points, _regions(spark, sf_dir))


def merge_ranges(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    spans = line.select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return ranges.merge_ranges(spans, "l_suppkey", unsigned=False)


def merge_ranges_one_group(spark, sf_dir):
    """All order keys' spans as one group, which is dealt over all parts."""
    orders = _table(spark, sf_dir, "orders")
    spans = orders.select(F.lit("all").alias("name"), (F.col("o_orderkey") * 7919 % 1000003).alias("lo"), (F.col("o_orderkey") * 7919 % 1000003 + F.col("o_custkey") % 60).alias("hi"))
    return ranges.merge_ranges(spans, "name", unsigned=False)


def range_join(spark, sf_dir):
    """Curve indexes of orders in ranges of suppliers."""
    low = F.col("s_suppkey") * 799819 % (1 << 26)
    spans = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("range_id"), low.alias("lo"), (low + F.col("s_suppkey") * 7919 % 50 * 1000003).alias("hi"))
    keys = _orders_index(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("h").alias("key"))
    return ranges.range_join(spans, keys)


def range_join_wide(spark, sf_dir):
    """128-bit indexes of customers in ranges of suppliers."""
    axes = F.array(*[(F.col("c_custkey") * (2 * i + 1) + 37 * i) % 256 for i in range(16)])
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), curve.encode(axes, 16, 8).alias("key"))
    k = F.col("s_suppkey")
    end = lambda x, tail: F.concat(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit(tail))
    low = k * 2654435761 % (1 << 32)
    spans = _table(spark, sf_dir, "supplier").select(k.alias("range_id"), end(low, "80000000000000000000001f").alias("lo"), end(F.least(low + k * 10007 % 90 * 1000003, F.lit((1 << 32) - 1)), "7fffffffffffffff12345678").alias("hi"))
    return ranges.range_join(spans, keys)


def curve_checksum(spark, sf_dir):
    return checks.checksum(curve2d_encode(spark, sf_dir), "h")


def hk1_position(spark, sf_dir):
    p = _embeddings(spark, sf_dir).select("vec_id", F.posexplode(markers.position("embedding", SPACE)).alias("axis", "p"))
    return p.select("vec_id", "axis", F.round("p", 6).alias("p"))


def hk1_range_filter(spark, sf_dir):
    """Markers in two ranges of keys, as a user writes them."""
    at = lambda head, tail: f"{SPACE.prefix}{head}{tail * (16 - len(head))}"
    return hk1_marker(spark, sf_dir).where(retrieval.in_ranges(F.col("marker"), [(at("1", "0"), at("5", "f")), (at("c4", "0"), at("d", "f"))]))


def hk1_prefix_filter(spark, sf_dir):
    return hk1_marker(spark, sf_dir).where(retrieval.has_prefix(F.col("marker"), SPACE.prefix + "7"))


def hk1_first_failing(spark, sf_dir):
    """Every eleventh vector but the first has no direction: the lowest of them is named, in any partitioning."""
    e = F.when(F.col("vec_id") % 11 == 10, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = _embeddings(spark, sf_dir).select("vec_id", e.alias("embedding"))
    return checks.first_failing(rows, "vec_id", markers.marker_error("embedding", SPACE, width=64))


def hk2_margins(spark, sf_dir):
    m = _embeddings(spark, sf_dir).select("vec_id", F.posexplode(lsh.margins("embedding", TABLES)).alias("t", "m"))
    m = m.select("vec_id", "t", F.posexplode("m").alias("j", "margin"))
    return m.select("vec_id", "t", "j", F.round("margin", 6).alias("margin"))


def hk2_recall(spark, sf_dir):
    exact = hk1_topk(spark, sf_dir)
    return retrieval.recall(exact, hk2_collisions(spark, sf_dir)).select("hits", "wanted", F.round("recall", 6).alias("recall"))


def s2_at_level(spark, sf_dir):
    at = _leaves(spark, sf_dir)
    return at.select("c_custkey", cells.token(cells.from_lat_lng("lat", "lng", 7)).alias("token"))


def s2_from_face_ij(spark, sf_dir):
    i, j = (F.col("c_custkey") * k % (1 << 30) for k in (7919 * 65537, 104729 * 4099))
    c = cells.from_face_ij(F.col("c_custkey") % 6, i, j)
    return _table(spark, sf_dir, "customer").select("c_custkey", c.alias("c")).select("c_custkey", hex16("c").alias("id"), cells.token(cells.from_face(F.col("c_custkey") % 6)).alias("face"))


def s2_range_filter(spark, sf_dir):
    """Leaves from the middle of face 2 to the middle of face 4: BIGINTs turn negative between."""
    low, high = (2 << 61) + (1 << 60), (4 << 61) + (1 << 60)
    return _leaves(spark, sf_dir).where(retrieval.in_cell_ranges(F.col("cell"), [(low, high)])).select("c_custkey", hex16("cell").alias("id"))


def s2_nested(spark, sf_dir):
    leaf = _leaves(spark, sf_dir)
    found = leaf.select(cells.parent("cell", 2).alias("cell")).unionByName(leaf.where("c_custkey % 2 = 0").select(cells.parent("cell", 5).alias("cell")))
    pairs = retrieval.nested_cells(found, [2, 5])
    return pairs.select(cells.token("outer").alias("outer_cell"), cells.token("inner").alias("inner_cell"))


def sql_functions(spark, sf_dir):
    """The curve and the cells by their names in SQL."""
    sql.register(spark)
    _xy(spark, sf_dir).createOrReplaceTempView("orbweave_xy")
    return spark.sql("SELECT l_orderkey, l_linenumber, h, hilbert_decode2(h, 16).x = x AS same FROM (SELECT *, hilbert_encode2(x, y, 16) AS h FROM orbweave_xy)")


def sql_names(spark, sf_dir):
    """Markers, hash keys and cells by their names in SQL."""
    sql.register(spark)
    _embeddings(spark, sf_dir).createOrReplaceTempView("orbweave_embeddings")
    return spark.sql("SELECT vec_id, hk1_marker(embedding) AS marker, array_join(transform(hk2_keys(embedding), k -> lower(lpad(hex(k), 2, '0'))), '.') AS keys FROM orbweave_embeddings")


def sql_cells(spark, sf_dir):
    sql.register(spark)
    _leaves(spark, sf_dir).createOrReplaceTempView("orbweave_places")
    found = spark.sql("SELECT c_custkey, cell_id(lat, lng, 7) AS cell FROM orbweave_places")
    return found.select("c_custkey", cells.token("cell").alias("token"))


def sql_probe_ranges(spark, sf_dir):
    """A table function over whole batches of a table."""
    sql.register(spark)
    _embeddings(spark, sf_dir).createOrReplaceTempView("orbweave_embeddings")
    return spark.sql("SELECT id AS vec_id, lo, hi FROM probe_ranges_of(TABLE(orbweave_embeddings), 1, 8)")


def sql_cover_regions(spark, sf_dir):
    sql.register(spark)
    _regions(spark, sf_dir).where("kind = 'cap'").createOrReplaceTempView("orbweave_regions")
    found = spark.sql("SELECT * FROM cover_regions_of(TABLE(orbweave_regions), 5, 2048)")
    return found.select("region_id", cells.token("cell").alias("token"), "inside")


def sql_cover_cells(spark, sf_dir):
    """The row-wise table functions, in lateral joins: the cells that hold a disc around each customer."""
    sql.register(spark)
    _leaves(spark, sf_dir).createOrReplaceTempView("orbweave_places")
    found = spark.sql("SELECT c_custkey, c.cell FROM orbweave_places, LATERAL cover_cells(lat, lng, c_custkey * 10) c")
    return found.select("c_custkey", cells.token("cell").alias("token"))


def sql_walks(spark, sf_dir):
    """Five steps of the curve from every supplier's key."""
    sql.register(spark)
    _table(spark, sf_dir, "supplier").createOrReplaceTempView("orbweave_suppliers")
    return spark.sql("SELECT s_suppkey, CAST(w.index AS BIGINT) AS at, w.point[0] AS x0, w.point[1] AS x1, w.point[2] AS x2 FROM orbweave_suppliers, LATERAL curve_walk(3, 10, CAST(s_suppkey * 7919 AS DECIMAL(38, 0)), 5) w")


def hk1_written_filter(spark, sf_dir):
    """A written table of markers, clustered, filtered by ranges that reach its scan."""
    written = Workspace(spark, "markers").save(layout.cluster_by(hk1_marker(spark, sf_dir), "marker"), "markers")
    at = lambda head, tail: f"{SPACE.prefix}{head}{tail * (16 - len(head))}"
    return written.where(retrieval.in_ranges(F.col("marker"), [(at("1", "0"), at("5", "f")), (at("c4", "0"), at("d", "f"))]))


def hk1_rescaled(spark, sf_dir):
    """Markers of vectors scaled by 2**100 and 2**-100, where squares leave 32 bits, are those of the vectors."""
    e = lambda k: F.transform("embedding", lambda x: (x * float(2.0**k)).cast("float"))
    m = _embeddings(spark, sf_dir).select("vec_id", markers.marker("embedding", SPACE).alias("m"), markers.marker(e(100), SPACE).alias("up"), markers.marker(e(-100), SPACE).alias("down"))
    return m.select("vec_id", F.col("m").alias("marker"), ((F.col("up") == F.col("m")) & (F.col("down") == F.col("m"))).alias("same"))


def hk2_first_failing(spark, sf_dir):
    """As ``hk1_first_failing``, for hash keys: the lowest vector of another width."""
    e = F.when(F.col("vec_id") % 13 == 7, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))
    rows = _embeddings(spark, sf_dir).select("vec_id", e.alias("embedding"))
    return checks.first_failing(rows, "vec_id", lsh.key_error("embedding", width=64))


def curve2d_points(spark, sf_dir):
    """Structs of two coordinates, the form that decoding gives."""
    p = _orders_index(spark, sf_dir).select("o_orderkey", curve.decode2("h", ORDER).alias("p"))
    return p.select("o_orderkey", curve.encode2_point("p", ORDER).alias("h"))


def curve_walk_source(spark, sf_dir):
    """The data source in SQL: the points of the curve at the order keys."""
    sql.register(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    orders.createOrReplaceTempView("orbweave_orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW orbweave_walk USING curve_walk OPTIONS (dims 3, bits 10, count {last + 1}, rows_per_task 65536)")
    return spark.sql("SELECT o_orderkey, point[0] AS x0, point[1] AS x1, point[2] AS x2 FROM orbweave_orders JOIN orbweave_walk ON index = o_orderkey")


def hk1_pruned_topk(spark, sf_dir):
    """``hk1_topk`` by bounds: blocks of cells that can't hold a better row are left out."""
    data = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    found = nearest.pruned_topk(_asked(spark, sf_dir), data, k=10).rows
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _forest(spark, sf_dir):
    data = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return forest.candidates(_asked(spark, sf_dir), data, reach=REACH, space=FOREST)


def hk2_forest_topk(spark, sf_dir):
    data = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    found = retrieval.rerank(_forest(spark, sf_dir), _asked(spark, sf_dir), data, k=10)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def hk2_forest_recall(spark, sf_dir):
    found = retrieval.recall(hk1_topk(spark, sf_dir), _forest(spark, sf_dir))
    return found.select("hits", "wanted", F.round("recall", 6).alias("recall"))


def _put(frame, name):
    """Lines ``value`` as text files, and their folder."""
    path = f"{Workspace(frame.sparkSession, name).path}/lines"
    frame.write.text(path)
    return path


def _spoilt(spark, sf_dir):
    """Embeddings as JSON lines; of every 23 one is all zeros, one too short, one no number, one too long."""
    k, e = F.col("vec_id") % 23, F.col("embedding")
    e = F.when(k == 3, F.transform(e, lambda x: x * 0)).when(k == 5, F.slice(e, 1, 63)).otherwise(e)
    rows = _embeddings(spark, sf_dir).select(F.to_json(F.named_struct(F.lit("id"), F.col("vec_id"), F.lit("embedding"), e)).alias("value"), k.alias("k"))
    value = F.when(F.col("k") == 7, F.regexp_replace("value", r"\[", '["x",')).when(F.col("k") == 11, F.rpad("value", 9000, " ")).otherwise(F.col("value"))
    return _put(rows.select(value.alias("value")), "embedding-lines")


def embedding_lines(spark, sf_dir):
    """Written JSON lines read again: what is wrong with each, and whether its error names its own file and line."""
    rows = lines.read_embeddings(spark, _spoilt(spark, sf_dir), width=64, max_line=8000, numbered=True)
    own = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(": "))
    error = F.when(F.startswith("error", own), F.substr("error", F.length(own) + 1))
    return rows.select(F.col("id").cast("long").alias("vec_id"), error.alias("error"), F.size("embedding").alias("width"))


def numbered_lines(spark, sf_dir):
    """Every file's lines are numbered from 1 without a gap: the number of lines, and of those whose number is wrong."""
    path = _put(_table(spark, sf_dir, "orders").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")), "numbered")
    rows = lines.numbered_lines(spark, path).select("line", F.col("value").cast("long").alias("key"), "file")
    least = rows.groupBy("file").agg(F.min("key").alias("least"), F.max("line").alias("last"), F.count("*").alias("n"), F.count_distinct("line").alias("lines"), F.min("line").alias("first"))
    return least.agg(F.sum("n").alias("n"), F.sum(F.when((F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("lines") == F.col("n")), 0).otherwise(1)).alias("wrong"))


def point_lines(spark, sf_dir):
    """Points of customers as ``LAT LNG`` lines, every ninth with a third number, read again as cells."""
    p = _leaves(spark, sf_dir).select(F.concat_ws(" ", F.col("lat").cast("string"), F.col("lng").cast("string"), F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey").cast("string"))).alias("value"))
    rows = lines.read_points(spark, _put(p, "point-lines"), numbered=True)
    good = rows.where("error is null").select(cells.token(cells.parent(cells.from_lat_lng("lat", "lng"), 12)).alias("token"))
    return good.unionByName(rows.where("error is not null").select(F.substring_index("error", ": ", -1).alias("token"))).groupBy("token").agg(F.count("*").alias("n"))


def marker_text(spark, sf_dir):
    """``ID<TAB>MARKER`` lines, read again."""
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.lit("BIGINT").alias("kind"), markers.marker("embedding", SPACE).alias("marker"))
    part = F.split("value", "\t")
    return spark.read.text(_put(lines.marker_lines(rows), "marker-text")).select(part[0].cast("long").alias("vec_id"), part[1].alias("marker"))


def marker_json(spark, sf_dir):
    """JSON lines with ``id`` and ``marker``, read again."""
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id_json"), markers.marker("embedding", SPACE).alias("marker"))
    return spark.read.schema("id long, marker string").json(_put(lines.json_lines(rows, "marker"), "marker-json")).select(F.col("id").alias("vec_id"), "marker")


def hash_json(spark, sf_dir):
    """JSON lines with hash keys, read again."""
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id_json"), "embedding")
    read = spark.read.schema("id long, marker string, keys array<string>").json(_put(lines.hash_lines(rows, space=TABLES), "hash-json"))
    return read.select(F.col("id").alias("vec_id"), "marker", F.array_join("keys", ".").alias("keys"))


def range_text(spark, sf_dir):
    """``LO HI`` lines of the cells of level 4 that hold customers, read again."""
    r = _leaves(spark, sf_dir).select(cells.id_range(cells.parent("cell", 4)).alias("r")).distinct().select("r.lo", "r.hi")
    part = F.split("value", " ")
    return spark.read.text(_put(lines.range_lines(r), "range-text")).select(part[0].alias("lo"), part[1].alias("hi"))


def marker_stream(spark, sf_dir):
    """The spoilt lines as a stream that keeps good rows, sets bad ones aside and marks its batches."""
    ws = Workspace(spark, "marker-stream")
    keep_stream(stream_markers(spark, _spoilt(spark, sf_dir), space=SPACE, width=64), f"{ws.path}/out", f"{ws.path}/state", availableNow=True).awaitTermination()
    good = kept(spark, f"{ws.path}/out").select(F.col("id").cast("long").alias("vec_id"), "marker", F.lit(None).cast("string").alias("error"))
    return good.unionByName(kept(spark, f"{ws.path}/out", "bad").select(F.col("id").cast("long").alias("vec_id"), "marker", "error"))


QUERIES = {
    f.__name__: f
    for f in (
        curve2d_encode, curve2d_encode_fold, curve2d_decode, curve2d_roundtrip, curve2d_order32, curve_clustered_sort, curve_density,
        curvend_encode, curvend_decode, curvend_wide, curve_walk, hk1_cell, hk1_marker, hk1_marker_cell, hk1_range, hk1_shared_prefix, hk1_parse,
        hk1_probe_ranges, hk1_candidates, hk1_topk, hk2_marker, hk2_parse, hk2_bucket_sizes, hk2_collisions, hk2_multiprobe, hk2_topk,
        s2_leaf, s2_hierarchy, s2_density, s2_token_roundtrip, s2_neighbours, s2_center, s2_covering, s2_cover, s2_points_in_cover, merge_ranges,
        curve_checksum, hk1_position, hk1_range_filter, hk1_prefix_filter, hk1_first_failing, hk2_margins, hk2_recall,
        s2_at_level, s2_from_face_ij, s2_range_filter, s2_nested, sql_functions,
        sql_names, sql_cells, sql_probe_ranges, sql_cover_regions, sql_cover_cells, sql_walks, hk1_written_filter, hk1_rescaled, hk2_first_failing, curve2d_points,
        curve_walk_source, s2_points_in_regions, merge_ranges_one_group, range_join, range_join_wide, hk1_pruned_topk, hk2_forest_topk, hk2_forest_recall,
        embedding_lines, numbered_lines, point_lines, marker_text, marker_json, hash_json, range_text, marker_stream,
    )
}
