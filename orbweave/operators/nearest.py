"""Exact nearest neighbours by cosine that skip what a bound excludes.

Rows are dealt to the cells of a one-bit ``hk1`` space, of as many axes as the
table's size asks for (``2 ** MOST_AXES`` cells at most), and packed, in order of
their distance from the cell's centre, into blocks that know the ring in which
they lie.  Queries are packed into groups in the order of their own cells.

A group first meets the blocks of its own cells.  The k-th cosine that a query
finds there is a distance within which everything better must lie, so by the
triangle inequality only certain rings of the other cells are left; blocks
outside all rings are neither shipped nor scored.  Bounds hold for any data;
how much they skip depends on it (``Found.share``): vectors in clusters leave a
few blocks, vectors without structure nearly all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import markers
from orbweave.functions.vectors import matrix
from orbweave.operators.retrieval import block_topk
from orbweave.workspace import Workspace

#: Rows of a block and of a group of queries, rows meant for a cell, blocks that one task joins at a time.
BLOCK, GROUP, PER_CELL, SHARE, MOST_AXES = 2048, 256, 4096, 16, 12
SLACK = 1e-6
PACKED = "block long, cells array<int>, low double, high double, n long, ids array<long>, vectors array<float>"


class Found:
    """``rows (query_id, id, cosine, rank)``, and what the search has read for them."""

    def __init__(self, rows: DataFrame, ws: Workspace, n_queries: int, n_rows: int):
        self.rows, self._ws, self._all = rows, ws, n_queries * n_rows

    def share(self) -> float:
        """Scored pairs of a query and a row, as a share of all."""
        pairs = self._ws.load("near-pairs").unionByName(self._ws.load("far-pairs"))
        return (pairs.agg(F.sum("scored")).first()[0] or 0) / max(1, self._all)


def _unit(e: np.ndarray) -> np.ndarray:
    size = np.sqrt((e * e).sum(axis=1))
    return e / np.where(size > 0, size, 1)[:, None]


def _vectors(column) -> np.ndarray:
    """The rows of a list column; they must have one width and finite values."""
    width = len(column[0]) if len(column) else 0
    e, _, odd = matrix(column, width)
    if odd.any() or not np.isfinite(e).all():
        raise ValueError("embeddings must have one width and finite values")
    return e.astype(np.float64)


class _Cells:
    """Centres of the cells; 2 ** MOST_AXES at most."""

    def __init__(self, sums: list[tuple[int, int, list[float]]]):
        if len({len(s[2]) for s in sums}) > 1:
            raise ValueError("embeddings must have one width and finite values")
        self.names = np.array([s[0] for s in sums], np.int64)
        self.centres = np.array([np.array(s[2]) / s[1] for s in sums]) if sums else np.zeros((0, 0))
        self.place = {int(c): i for i, c in enumerate(self.names)}

    def far(self, unit: np.ndarray) -> np.ndarray:
        square = (unit * unit).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * unit @ self.centres.T
        return np.sqrt(np.maximum(square, 0))


def pruned_topk(queries: DataFrame, data: DataFrame, *, k: int) -> Found:
    """The ``k`` rows of ``data (id, embedding)`` of highest cosine for each of ``queries (query_id, embedding)``.

    The same rows as scoring every pair: ties go to the lesser id, zero vectors
    have a null cosine and come last, null embeddings are left out; ids are BIGINTs.
    """
    spark = data.sparkSession
    ws = Workspace(spark, "nearest")
    of = lambda t, name: t.where("embedding is not null").select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    queries, data = of(queries, "query_id"), of(data, "id")
    n_queries, n_rows = queries.count(), data.count()
    axes = min(MOST_AXES, max(1, (n_rows // PER_CELL).bit_length()))
    space = markers.Space(axes, 1)
    cell = F.coalesce(F.conv(markers.key("embedding", space, invalid="null"), 16, 10).cast("int"), F.lit(-1)).alias("cell")
    data = ws.save(data.select("id", "embedding", cell), "data")

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                cells, unit = batch.column(0).to_numpy(), _unit(_vectors(batch.column(1)))
                for c in np.unique(cells).tolist():
                    part = unit[cells == c]
                    total[c] = total.get(c, 0) + np.concatenate([[len(part)], part.sum(axis=0)])
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([int(total[c][0]) for c in names], pa.int64()), pa.array([total[c][1:].tolist() for c in names], pa.list_(pa.float64()))], ["cell", "n", "total"])

    added = data.select("cell", "embedding").mapInArrow(sums, "cell int, n long, total array<double>")
    axis = added.select("cell", "n", F.posexplode("total").alias("axis", "x")).groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    centres = axis.groupBy("cell").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias("total"))
    cells = spark.sparkContext.broadcast(_Cells([(r.cell, r.n, r.total) for r in centres.orderBy("cell").collect()]))  # a row per cell, 2 ** MOST_AXES at most

    def distances(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                names = batch.column(2).to_numpy()
                unit, at = _unit(_vectors(batch.column(1))), np.array([cells.value.place.get(c, -1) for c in names.tolist()])
                d = np.sqrt(((unit - cells.value.centres[at]) ** 2).sum(axis=1)) if len(cells.value.names) else np.zeros(len(unit))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(d)], ["id", "embedding", "cell", "d"])

    def packed(rows: DataFrame, size: int, parts: int, by_cell: bool, name: str) -> DataFrame:
        far = rows.mapInArrow(distances, "id long, embedding array<float>, cell int, d double")
        dealt = far.repartitionByRange(parts, "cell", "d", "id").sortWithinPartitions("cell", "d", "id")
        return ws.save(dealt.select(F.spark_partition_id().alias("part"), "cell", "d", "id", "embedding").mapInArrow(_pack(size, by_cell), PACKED), name)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = packed(data, BLOCK, max(parts, n_rows // (16 * BLOCK)), True, "blocks")
    groups = packed(queries.select("id", "embedding", cell), GROUP, max(1, n_queries // (2 * GROUP)), False, "groups")

    near = _search(ws, cells, groups.withColumn("found", F.lit(None).cast("array<struct<query_id:bigint,least:double>>")), blocks, k, "near", own=True)
    least = near.where("cosine is not null").groupBy("g", "query_id").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).where(F.col("n") >= k)
    bounds = least.groupBy(F.col("g").alias("block")).agg(F.collect_list(F.struct("query_id", "least")).alias("found"))
    far = _search(ws, cells, groups.join(bounds, "block", "left"), blocks, k, "far", own=False)
    both = _best(near.unionByName(far), k)
    return Found(both.select("query_id", "id", "cosine", "rank"), ws, n_queries, n_rows)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cosine"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _pack(size: int, by_cell: bool):
    """Consecutive rows ``(part, cell, d, id, embedding)`` as blocks of up to ``size``, of one cell each if ``by_cell``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[pa.RecordBatch] = []
        at = 0

        def row(rows: list) -> pa.RecordBatch:
            nonlocal at
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            d = t.column(2).to_numpy()
            values = [(t.column(0)[0].as_py() << 32) + at, sorted(set(t.column(1).to_pylist())), d.min(), d.max(), len(t)]
            at += 1
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.int64()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (t.column(3), t.column(4).flatten())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)] + lists, ["block", "cells", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            names = batch.column(1).to_numpy()
            start = 0
            while start < len(batch):
                n = sum(map(len, held))
                if held and by_cell and held[-1].column(1)[-1].as_py() != names[start] or n >= size:
                    yield row(held)
                    held, n = [], 0
                stop = min(len(batch), start + size - n)
                if by_cell:
                    stop = start + int(np.searchsorted(names[start:stop], names[start], "right"))
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield row(held)

    return run


def _search(ws: Workspace, cells, groups: DataFrame, blocks: DataFrame, k: int, name: str, *, own: bool) -> DataFrame:
    """The ``k`` best of each query ``(g, query_id, id, cosine)`` among the blocks of its group's own cells, or of the others that its bound leaves."""

    def rings(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                mine = set(r["cells"])
                if own:
                    at = np.array([cells.value.place[c] for c in mine if c in cells.value.place], np.int64)
                    low, high = np.full(len(at), -np.inf), np.full(len(at), np.inf)
                else:
                    unit = _unit(np.array(r["vectors"], np.float64).reshape(r["n"], -1))
                    least = {x["query_id"]: x["least"] for x in r["found"] or []}
                    reach = np.array([np.sqrt(max(0.0, 2 - 2 * least[i])) if i in least else np.inf for i in r["ids"]])
                    far = cells.value.far(unit)
                    low, high = (far - reach[:, None]).min(0) - SLACK, (far + reach[:, None]).max(0) + SLACK
                    at = np.array([i for i, c in enumerate(cells.value.names.tolist()) if c not in mine], np.int64)
                    low, high = low[at], high[at]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(at), pa.int64()), pa.array([r["n"]] * len(at), pa.int64()), pa.array(cells.value.names[at], pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["g", "gn", "cell", "least", "most"])

    wanted = groups.select("block", "cells", "n", "ids", "vectors", "found").mapInArrow(rings, "g long, gn long, cell int, least double, most double")
    held = blocks.select("block", F.col("cells")[0].alias("cell"), "low", "high", "n")
    meet = wanted.join(held, "cell").where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")))
    pairs = ws.save(meet.select("g", "block", (F.col("gn") * F.col("n")).alias("scored")), f"{name}-pairs")
    shares = pairs.groupBy("g").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = pairs.join(shares, "g").select("g", "block", F.pmod(F.xxhash64("block"), F.col("shares")).alias("share"))
    left = dealt.join(blocks.select("block", "ids", "vectors"), "block").select("g", "share", "ids", "vectors")
    asked = groups.select(F.col("block").alias("g"), "ids", "vectors")
    right = dealt.select("g", "share").distinct().join(asked, "g").select(F.col("g").alias("rg"), F.col("share").alias("rshare"), "ids", "vectors")

    def score(data, group):
        import pyarrow as pa

        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        q_ids, ids = flat(group, 2), flat(data, 2)
        q, e = flat(group, 3).reshape(len(q_ids), -1), flat(data, 3).reshape(len(ids), -1)
        if q.shape[1] != e.shape[1]:
            raise ValueError("embeddings must have one width and finite values")
        i, j, cosine = block_topk(q, ids, e, k)
        return pa.table({"g": pa.array([group.column(0)[0].as_py()] * len(i), pa.int64()), "query_id": pa.array(q_ids[i], pa.int64()), "id": pa.array(ids[j], pa.int64()), "cosine": pa.array(cosine, pa.float64(), mask=np.isnan(cosine))})

    found = left.groupBy("g", "share").cogroup(right.groupBy("rg", "rshare")).applyInArrow(score, "g long, query_id long, id long, cosine double")
    return ws.save(_best(found, k).drop("rank"), name)

