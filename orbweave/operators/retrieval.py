"""Retrieval over keys: probes, bucket collisions, cell containment and exact reranking, as equi-joins.

A range of keys at one level is a union of whole cells, so a range join becomes
a hash or sort-merge join on the cell's first key, which Spark can shuffle,
broadcast or split where a cell is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import cells, lsh, markers
from orbweave.functions.vectors import matrix
from orbweave.operators.ranges import merge_ranges  # noqa: F401

#: Rows of a block of the exact search, and queries scored at a time; products closer than SLACK are told apart in order of input.
DATA_BLOCK, QUERY_BLOCK, SCORED, SLACK = 16384, 4096, 256, 1e-9


def in_ranges(column: Column, ranges: list[tuple[str, str]]) -> Column:
    """``column BETWEEN lo AND hi OR ...``, which reaches the Parquet scan; for a few ranges planned on the driver."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | column.between(low, high)
    return found


def in_cell_ranges(column: Column, ranges: list[tuple[int, int]]) -> Column:
    """As ``in_ranges`` for cell ids, given as unsigned numbers: a range is cut where BIGINTs turn negative, so each part reaches the scan."""
    half, parts = 1 << 63, []
    for low, high in ranges:
        parts += [(a, b) for a, b in ((low, min(high, half - 1)), (max(low, half), high)) if a <= b]
    signed = lambda x: F.lit(x - (1 << 64) if x >= half else x)
    return in_ranges(column, [(signed(a), signed(b)) for a, b in parts])


def has_prefix(column: Column, head: str) -> Column:
    """Keys that begin with ``head``; reaches the scan as a prefix filter."""
    return column.startswith(head)


def nested_cells(found: DataFrame, levels: list[int]) -> DataFrame:
    """Pairs ``(outer, inner)`` of ``found (cell)`` of which the first holds the second and is not the same.

    ``levels`` are those at which the table has cells; a cell's ancestors at
    them are the join keys, so the self join is an equi-join.
    """
    one = found.select("cell").distinct()
    up = F.array(*[F.when(cells.level("cell") > x, cells.parent("cell", x)) for x in sorted(levels)])
    inner = one.select(F.col("cell").alias("inner"), F.explode(F.filter(up, lambda c: c.isNotNull())).alias("outer"))
    return inner.join(one.withColumnRenamed("cell", "outer"), "outer").select("outer", "inner")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``(hits, wanted, recall)``: how many of the exact ``(query_id, id)`` pairs a search finds."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hit.agg(F.count("hit").alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))


def probe_candidates(queries: DataFrame, data: DataFrame, *, level: int, n: int = 8, space: markers.Space = markers.Space()) -> DataFrame:
    """Pairs ``(query_id, id)`` whose key lies in one of the query's probed cells.

    ``queries (query_id, embedding)``, ``data (id, key)``.  Probed cells of one
    query are distinct, so no pair comes twice.
    """
    ranges = queries.select("query_id", F.explode(markers.probes("embedding", level, n, space, merged=False)).alias("r"))
    asked = ranges.select("query_id", F.col("r.lo").alias("cell"))
    return data.select("id", markers.cell_low("key", level, space).alias("cell")).join(asked, "cell").select("query_id", "id")


def bucket_candidates(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs that share a key in at least one table, once each: ``queries (query_id, keys)``, ``data (id, keys)``."""
    return _collide(queries.select("query_id", F.transform("keys", lambda x: F.array(x)).alias("tried")), data)


def multiprobe_candidates(queries: DataFrame, data: DataFrame, *, n: int, space: lsh.Tables = lsh.Tables()) -> DataFrame:
    """As ``bucket_candidates``, looking up the ``n`` likeliest keys of each table: ``queries (query_id, embedding)``."""
    return _collide(queries.select("query_id", lsh.probes("embedding", n, space).alias("tried")), data)


def _sorted_keys(held: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table of keys ``[row, table]`` its rows in the order of keys, and the keys."""
    order = np.argsort(held, axis=0, kind="stable")
    return [(order[:, t], held[order[:, t], t]) for t in range(held.shape[1])]


def sharing(tried: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """``[query, row]``: whether one of the keys ``tried [query, table, probe]`` is the row's in that table; ``tables`` are ``_sorted_keys`` of n rows."""
    out = np.zeros((len(tried), n), bool)
    for t, (order, keys) in enumerate(tables):
        for p in range(tried.shape[2]):
            low, high = (np.searchsorted(keys, tried[:, t, p], side) for side in ("left", "right"))
            count = high - low
            at = np.repeat(np.arange(len(tried)), count)
            out[at, order[low[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]] = True
    return out


def _nested(column, depth: int) -> np.ndarray:
    """Lists of one length each, ``depth`` times nested, as an array."""
    shape, n = [len(column)], len(column)
    for _ in range(depth):
        column = column.flatten()
        if n and len(column) % n:
            raise ValueError("keys must be of the same tables")
        shape.append(len(column) // n if n else 0)
        n = len(column)
    return column.to_numpy(zero_copy_only=False).reshape(shape)


def _one_each(ids) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order in which equal ids are together, and where each id begins."""
    code = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def _pairs_of(query_ids, tried: np.ndarray, ids, held: np.ndarray):
    """Stretches of the pairs of a block of queries and one of rows, positions in both."""
    (q_order, q_first), (order, first) = _one_each(query_ids), _one_each(ids)
    tables = _sorted_keys(held[order])
    for at in range(0, len(q_first), SCORED):
        begin, end = q_first[at], q_first[at + SCORED] if at + SCORED < len(q_first) else len(q_order)
        met = sharing(tried[q_order[begin:end]], tables, len(order))
        met = np.logical_or.reduceat(met, first, axis=1) if len(first) < len(order) else met
        own = q_first[at : at + SCORED]
        met = np.logical_or.reduceat(met, own - begin, axis=0) if len(own) < end - begin else met
        i, j = np.nonzero(met)
        yield q_order[own[i]], order[first[j]]


def _blocks(queries: DataFrame, data: DataFrame) -> tuple[int, int]:
    return -(-queries.count() // QUERY_BLOCK) or 1, -(-data.count() // DATA_BLOCK) or 1


def _collide(asked: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs ``(query_id, id)`` of ``asked (query_id, tried)`` and ``data (id, keys)``.

    Every block of queries meets every block of rows, where a pair is found
    once however many keys it shares: only keys are exchanged, no pairs.
    """
    asked, data = asked.where("tried is not null"), data.select("id", "keys").where("keys is not null")
    q_blocks, d_blocks = _blocks(asked, data)
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = dict(asked.dtypes) | dict(data.dtypes)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = asked.select(block("query_id", q_blocks).alias("qb"), every(d_blocks).alias("db"), F.lit(0).alias("side"), "query_id", F.col("tried").cast("array<array<long>>").alias("tried"), none(kinds["id"], "id"), none("array<long>", "keys"))
    right = data.select(every(q_blocks).alias("qb"), block("id", d_blocks).alias("db"), F.lit(1).alias("side"), none(kinds["query_id"], "query_id"), none("array<array<long>>", "tried"), "id", F.col("keys").cast("array<long>").alias("keys"))

    def run(batches):
        import pyarrow as pa

        def pairs(held):
            sides = [pa.Table.from_batches([b for k, b in held if k == side]).combine_chunks().to_batches() for side in (0, 1)] if {k for k, _ in held} == {0, 1} else None
            if sides:
                (q,), (d,) = sides
                for i, j in _pairs_of(q.column(3), _nested(q.column(4), 2), d.column(5), _nested(d.column(6), 1)):
                    yield pa.RecordBatch.from_arrays([q.column(3).take(pa.array(i)), d.column(5).take(pa.array(j))], ["query_id", "id"])

        held, now = [], None
        for batch in batches:
            places = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(places)]):
                if end == at:
                    continue
                if tuple(places[at, :2]) != now:
                    yield from pairs(held)
                    held, now = [], tuple(places[at, :2])
                held.append((int(places[at, 2]), batch.slice(at, end - at)))
        yield from pairs(held)

    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    met = left.unionByName(right).repartition(parts, "qb", "db").sortWithinPartitions("qb", "db", "side")
    return met.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}")


def bucket_sizes(data: DataFrame) -> DataFrame:
    """``(t, key, n)``: rows per bucket of ``data (keys)``, summed before the exchange."""
    return data.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n"))


def cosine(a, b) -> Column:
    """Of two float arrays, summed in double precision in their order; null if one is zero."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return total(a, b) / F.nullif(size, F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, data: DataFrame, *, k: int) -> DataFrame:
    """The ``k`` candidates of highest cosine per query: ``(query_id, id, cosine, rank)``; ties go to the lesser id."""
    full = candidates.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(data.select("id", F.col("embedding").alias("d")), "id")
    scored = full.select("query_id", "id", cosine("q", "d").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cosine"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def block_topk(q: np.ndarray, ids: np.ndarray, e: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and cosines of the ``k`` best rows of ``e`` for each row of ``q``: NaN if one is zero, these last; ties go to the lesser id.

    ``allowed(a, b)`` tells which rows count for each of the queries from a to b.
    """

    def size(x):
        total = np.zeros(len(x))
        for i in range(x.shape[1]):
            total += x[:, i] * x[:, i]
        return np.sqrt(total)

    q, e = q.astype(np.float64), e.astype(np.float64)
    q_size, e_size = size(q), size(e)
    unit = e / np.where(e_size > 0, e_size, 1)[:, None]
    out = []
    for at in range(0, len(q), SCORED):
        part, own = q[at : at + SCORED], q_size[at : at + SCORED]
        score = part / np.where(own > 0, own, 1)[:, None] @ unit.T
        score[:, e_size == 0] = -2
        counts = True if allowed is None else allowed(at, at + len(part))
        score = score if allowed is None else np.where(counts, score, -np.inf)
        least = np.partition(score, -k, axis=1)[:, -k] if k < len(e) else np.full(len(part), -np.inf)
        i, j = np.nonzero((score >= least[:, None] - SLACK) & counts)
        dot = np.zeros(len(i))
        for x in range(q.shape[1]):
            dot += part[i, x] * e[j, x]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where((own[i] > 0) & (e_size[j] > 0), dot / (own[i] * e_size[j]), np.nan)
        order = np.lexsort((ids[j], -cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first] + at, j[first], cosine[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def exact_topk(queries: DataFrame, data: DataFrame, *, k: int) -> DataFrame:
    """As ``rerank`` over all pairs of ``queries (query_id, embedding)`` and ``data (id, embedding)``, ids being BIGINTs.

    Every query meets every row, a block of each at a time; a pair of blocks
    yields ``k`` rows per query.  Null embeddings are left out.
    """
    return _blocked_topk(queries, data, k)


def bucket_topk(queries: DataFrame, data: DataFrame, *, k: int) -> DataFrame:
    """As ``rerank`` of ``bucket_candidates``, of ``queries (query_id, embedding, keys)`` and ``data (id, embedding, keys)`` with distinct ids.

    Candidates are found and scored where a block of queries meets one of rows: no pair is exchanged but the best.
    """
    return _blocked_topk(queries.where("keys is not null"), data.where("keys is not null"), k, "keys")


def _blocked_topk(queries: DataFrame, data: DataFrame, k: int, *keys: str) -> DataFrame:
    queries, data = queries.where("embedding is not null"), data.where("embedding is not null")
    q_blocks, d_blocks = _blocks(queries, data)
    more = [F.col(c).cast("array<long>").alias(c) for c in keys]
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(block("query_id", q_blocks).alias("qb"), every(d_blocks).alias("db"), F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"), *more)
    held = data.select(every(q_blocks).alias("qb"), block("id", d_blocks).alias("db"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), *more)

    def run(left, right):
        import pyarrow as pa

        q_ids, ids = (t.column(2).combine_chunks().to_numpy(zero_copy_only=False) for t in (left, right))
        if not len(q_ids) or not len(ids):
            i = j = np.empty(0, np.int64)
            cosines = np.empty(0)
        else:
            width = len(left.column(3)[0])
            (q, _, odd_q), (e, _, odd_e) = (matrix(t.column(3).combine_chunks(), width) for t in (left, right))
            for bad in (odd_q.any() | odd_e.any(), not (np.isfinite(q).all() and np.isfinite(e).all())):
                if bad:
                    raise ValueError("embeddings must have one width and finite values")
            allowed = None
            if keys:
                tried, held = (_nested(t.column(4).combine_chunks(), 1) for t in (left, right))
                tables = _sorted_keys(held)
                allowed = lambda a, b: sharing(tried[a:b, :, None], tables, len(e))
            i, j, cosines = block_topk(q, ids, e, k, allowed)
        return pa.table({"query_id": pa.array(q_ids[i], pa.int64()), "id": pa.array(ids[j], pa.int64()), "cosine": pa.array(cosines, pa.float64(), mask=np.isnan(cosines))})

    scored = asked.groupBy("qb", "db").cogroup(held.groupBy("qb", "db")).applyInArrow(run, "query_id long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cosine"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def points_in_cells(points: DataFrame, cover: DataFrame, *, cover_levels: list[int] | None = None) -> DataFrame:
    """Pairs of ``points (id, cell)`` and ``cover (region_id, cell)`` where the cover's cell holds the point.

    A point's ancestor at each level that the cover uses (31 at most) is the
    join key; nested cover cells of one region count once.
    """
    found = cover.select("region_id", F.col("cell").alias("ancestor")).distinct()
    if cover_levels is None:
        cover_levels = [r[0] for r in found.select(cells.level("ancestor")).distinct().collect()]  # 31 at most
    up = F.array(*[F.when(cells.level("cell") >= x, cells.parent("cell", x)) for x in sorted(cover_levels)])
    lifted = points.select("id", F.explode(F.filter(up, lambda c: c.isNotNull())).alias("ancestor"))
    return lifted.join(found, "ancestor").select("id", "region_id").distinct()
