"""Names for SQL: scalar functions on Arrow batches, and table functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, LongType, StringType, StructField, StructType

from orbweave.errors import EngineError, IndexOutOfRange
from orbweave.functions import cells, curve, lsh, markers
from orbweave.functions.vectors import hex_text, longs, matrix, to_longs


def _row(**kinds) -> StructType:
    """Types are built here, not parsed: no session is needed to import this module."""
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def _by_parameter(parameter, *columns, run):
    """``run(value, columns)`` for the rows of each value of a parameter that SQL passes as a column."""
    import pyarrow as pa

    values = np.asarray(parameter.fill_null(-1))
    if len(values) and (values == values[0]).all():
        return run(int(values[0]), columns)
    parts, order = [], []
    for v in np.unique(values).tolist():
        rows = np.flatnonzero(values == v)
        order.append(rows)
        parts.append(run(int(v), tuple(c.take(pa.array(rows)) for c in columns)))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order)))) if parts else pa.array([], pa.int64())


@F.arrow_udf(LongType())
def hilbert_encode2(x, y, bits):
    def run(order, columns):
        curve.check_order(order)
        (a, ga), (b, gb) = map(longs, columns)
        return to_longs(curve.encode2_array(order, a, b), ga & gb)

    return _by_parameter(bits, x, y, run=run)


@F.arrow_udf(_row(x=LongType(), y=LongType()))
def hilbert_decode2(h, bits):
    import pyarrow as pa

    def run(order, columns):
        curve.check_order(order)
        a, good = longs(columns[0])
        x, y = curve.decode2_array(order, a)
        return pa.StructArray.from_arrays([to_longs(x, good), to_longs(y, good)], names=["x", "y"], mask=pa.array(~good))

    return _by_parameter(bits, h, run=run)


@F.arrow_udf(StringType())
def hk1_marker(embedding):
    """Marker in the default space; null for embeddings that have none."""
    import pyarrow as pa

    space = markers.Space()
    e, absent, _ = matrix(embedding, None)
    where, code = markers.positions(e, space)
    keys = hex_text(*curve.encode_array(markers.cells_of(where, space.bits), space.bits), space.digits)
    return pa.array([space.prefix + k for k in keys.tolist()], pa.string(), mask=absent | (code > 0))


@F.arrow_udf(ArrayType(LongType()))
def hk2_keys(embedding):
    """Keys in the default tables."""
    import pyarrow as pa

    space = lsh.Tables()
    e, absent, _ = matrix(embedding, None)
    keys = lsh.keys_of(lsh.margins_of(e, space)).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(absent, 0, space.tables))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[~absent].ravel()), mask=pa.array(absent))


@F.arrow_udf(LongType())
def cell_id(lat, lng, level):
    """Cell of a point at a level; null for points that have none."""
    def run(at, columns):
        x, y, good = cells._lat_lng(*columns, "null")
        return to_longs(cells.raised(cells.leaves(x, y), at), good)

    return _by_parameter(level, lat, lng, run=run)


@F.arrow_udf(ArrayType(LongType()))
def cover_cells_array(lat, lng, radius_m):
    """Cells that hold a disc around a point; null if any argument is."""
    import pyarrow as pa

    absent = np.asarray(lat.is_null()) | np.asarray(lng.is_null()) | np.asarray(radius_m.is_null())
    x, y, radius = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lng, radius_m))
    home = cells.raised(cells.leaves(x, y), cells.covering_level(radius))
    around = np.sort(cells.neighbours(home, [(di, dj) for dj in (-1, 0, 1) for di in (-1, 0, 1)]), axis=1)
    once = np.concatenate([np.ones((len(around), 1), bool), around[:, 1:] != around[:, :-1]], axis=1) & ~absent[:, None]
    ends = np.concatenate([[0], np.cumsum(once.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(around[once].view(np.int64)), mask=pa.array(absent))


#: The cells of ``cover_cells_array`` as rows; Spark puts the body into the query, so a lateral join runs it on whole batches.
COVER_CELLS = "CREATE OR REPLACE TEMPORARY FUNCTION cover_cells(lat DOUBLE, lng DOUBLE, radius_m DOUBLE) RETURNS TABLE (cell BIGINT) RETURN SELECT * FROM explode(cover_cells_array(lat, lng, radius_m))"


@F.udtf(returnType=_row(index=DecimalType(38, 0), point=ArrayType(LongType())))
class CurveWalk:
    """``count`` points of the curve from index ``start`` on."""

    def eval(self, dims: int, bits: int, start, count: int):
        curve.check_space(dims, bits)
        start = int(start)
        if start < 0 or count < 0 or start + count > 1 << dims * bits:
            raise IndexOutOfRange(f"{start} + {count}")
        from decimal import Decimal

        for at in range(0, count, 4096):
            index = [start + k for k in range(at, min(at + 4096, count))]
            high, low = (np.array([i >> s & (1 << 64) - 1 for i in index], np.uint64) for s in (64, 0))
            for i, p in zip(index, curve.decode_array(high, low, dims, bits).tolist()):
                yield Decimal(i), p


@F.udtf(returnType=_row(lo=StringType(), hi=StringType()))
class ProbeRanges:
    """Key ranges of the default space to search around an embedding."""

    def eval(self, embedding: list, level: int, n: int):
        space = markers.Space()
        where, code = markers.positions(np.array([embedding], np.float32), space)
        if n < 1 or code.any():
            raise EngineError("no probes for this embedding")
        level = min(level, space.bits)
        found = markers._probe_rows(where, space, level, n, n.bit_length() - 1)[0] if level else [(0, (1 << space.key_bits) - 1)]
        for low, high in markers.merge(found):
            yield f"{low:0{space.digits}x}", f"{high:0{space.digits}x}"


@F.arrow_udtf(returnType=_row(id=LongType(), lo=StringType(), hi=StringType()))
class ProbeRangesOf:
    """``probe_ranges`` of the rows ``(id, embedding)`` of a table, a batch at a time."""

    def eval(self, rows, level, n):
        import pyarrow as pa

        if not len(rows):
            return
        space, level, n = markers.Space(), level[0].as_py(), n[0].as_py()
        e, absent, _ = matrix(rows.column(1), None)
        where, code = markers.positions(e.astype(np.float32), space)
        if n < 1 or code[~absent].any():
            raise EngineError("no probes for an embedding")
        level = min(level, space.bits)
        found = markers._probe_rows(where, space, level, n, n.bit_length() - 1) if level else [[(0, (1 << space.key_bits) - 1)]] * len(e)
        merged = [[] if a else markers.merge(r) for r, a in zip(found, absent.tolist())]
        at = np.repeat(np.arange(len(e)), [len(r) for r in merged])
        text = [[f"{x:0{space.digits}x}" for r in merged for x in (y[k] for y in r)] for k in (0, 1)]
        ids = rows.column(0).cast(pa.int64()).take(pa.array(at, pa.int64()))
        yield pa.Table.from_arrays([ids, *(pa.array(t, pa.string()) for t in text)], ["id", "lo", "hi"])


@F.arrow_udtf(returnType=_row(region_id=LongType(), cell=LongType(), inside=BooleanType()))
class CoverRegionsOf:
    """Covers of the rows ``(region_id, kind, points, radius_m)`` of a table: discs, polylines and polygons, a batch refined together."""

    def eval(self, rows, max_level, max_cells):
        import pyarrow as pa

        from orbweave.operators.covers import covered

        if len(rows):
            at, ids, inside = covered(rows.select(["kind", "points", "radius_m"]).to_pylist(), max_level=max_level[0].as_py(), max_cells=max_cells[0].as_py())
            region = rows.column("region_id").cast(pa.int64()).take(pa.array(at, pa.int64()))
            yield pa.Table.from_arrays([region, pa.array(ids.view(np.int64)), pa.array(inside)], ["region_id", "cell", "inside"])


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``: hilbert_encode2, hilbert_decode2, hk1_marker, hk2_keys, cell_id, cover_cells_array, curve_walk, probe_ranges, cover_cells.

    ``probe_ranges_of(TABLE(t), level, n)`` and ``cover_regions_of(TABLE(t), max_level, max_cells)`` take whole tables, in batches.
    ``curve_walk`` is a data source too, for long walks: ``CREATE TEMPORARY VIEW w USING curve_walk OPTIONS (dims 3, bits 10)``.
    """
    from orbweave.sources.walk import CurveWalkSource

    spark.dataSource.register(CurveWalkSource)
    for f in (hilbert_encode2, hilbert_decode2, hk1_marker, hk2_keys, cell_id, cover_cells_array):
        spark.udf.register(f.__name__, f)
    for name, f in (("curve_walk", CurveWalk), ("probe_ranges", ProbeRanges), ("probe_ranges_of", ProbeRangesOf), ("cover_regions_of", CoverRegionsOf)):
        spark.udtf.register(name, f)
    spark.sql(COVER_CELLS)
