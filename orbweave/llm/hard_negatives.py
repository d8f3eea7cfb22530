"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

Vectors are quantised to integers, and each gets one more component that makes
all of them equally long; an anchor's gets 0 there.  The greater the inner
product with an anchor, the nearer a vector then is to it, so distance bounds
hold for inner products.

``PIVOTS`` sampled vectors divide the space into Voronoi cells.  The vectors of a
cell, sorted by label and distance from its pivot, are packed into blocks of up
to ``BLOCK`` rows that know their label range and ring of distances; anchors are
packed into groups of up to ``GROUP``.  A search has two rounds: each group first
meets the blocks of its own cells, which gives every anchor the score that its
further finds must reach; with it, the triangle inequality and the bisecting
planes between pivots tell which rings of which other cells may hold more, and
only those blocks are copied to the group.  A group's blocks are split into
shares of about ``SHARE``, each joined exactly where it lands, so a hot cell is
many blocks in many tasks.  Positives are searched like that first, then
the negatives of every positive's window of scores.

Scores are exact: products of integers below 2**53 in double precision.  Vectors
without structure leave little to prune; ``Mined.shares`` says how much of all
pairs was scored.

Defined results: rows with a null id, label, vector or component, or a component
that isn't finite, take no part, nor do vectors whose quantised squared length
exceeds 2**53; of several rows with one id, the one of the smallest
(label, vector) takes part; missing components of shorter vectors are 0; an
anchor without positives, or a positive without negatives, has no rows.  Labels
are integers.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, shuffle_parts, table

PIVOTS, BLOCK, GROUP, SHARE = 64, 2048, 128, 24
LONGEST = float(1 << 53)
MEMBERS = "ids array<long>, labels array<long>, vectors binary"


def _stack(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of little-endian 32-bit components, short ones filled up with 0."""
    rows = [np.frombuffer(v, "<i4") for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _members(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.array(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["vectors"], "<i4").reshape(len(ids), -1).astype(np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = min(a.shape[1], b.shape[1])
    return a[:, :w] @ b[:, :w].T


def quantised(vectors: DataFrame, anchor: Column, *, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, anchor, label, v, n2)``: the rows that take part, one per id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, packed, lengths = [], [], []
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ends = lists.offsets.to_numpy()
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * flat)
                square = whole * whole
            for i in range(len(batch)):
                n2 = square[ends[i] : ends[i + 1]].sum()
                if n2 <= LONGEST:  # not if NaN
                    keep.append(i)
                    packed.append(whole[ends[i] : ends[i + 1]].astype("<i4").tobytes())
                    lengths.append(int(n2))
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(packed, pa.binary()), pa.array(lengths, pa.int64())], ["id", "anchor", "label", "v", "n2"])

    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    found = rows.mapInArrow(run, "id long, anchor boolean, label long, v binary, n2 long")
    return found.groupBy("id").agg(F.min(F.struct("label", "v", "n2", "anchor")).alias("r")).select("id", "r.*")


class _Space:
    """Pivots and the common squared length ``m2``; broadcast, PIVOTS vectors at most."""

    def __init__(self, vectors: list[bytes], m2: int):
        p = _stack(vectors).astype(np.float64)
        self.m2 = float(m2)
        self.slack = 1e-6 * (1 + np.sqrt(self.m2))
        self.rest = np.sqrt(np.maximum(self.m2 - (p * p).sum(1), 0))
        self.pivots = p
        apart = 2 * self.m2 - 2 * (_products(p, p) + np.outer(self.rest, self.rest))
        self.apart = np.sqrt(np.maximum(apart, 0))

    def of_rows(self, v: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """Distances of lengthened vectors from the pivots."""
        inner = _products(v, self.pivots) + np.outer(np.sqrt(np.maximum(self.m2 - n2, 0)), self.rest)
        return np.sqrt(np.maximum(2 * self.m2 - 2 * inner, 0))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] + self.m2 - 2 * _products(v, self.pivots), 0))

    def rings(self, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pivot, whether its cell may hold scores of ``least`` or more for any anchor, and between which distances."""
        far = self.of_anchors(v)
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(np.maximum((v * v).sum(1) + self.m2 - 2 * least, 0))  # infinite for a least of -infinity, below 0 for one of +infinity
        reach = np.where(least == np.inf, -np.inf, reach)
        near = far.argmin(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            plane = (far**2 - far[np.arange(len(far)), near][:, None] ** 2) / (2 * self.apart[near])
        plane = np.where(self.apart[near] > self.slack, plane, 0)
        open_ = (plane <= reach[:, None] + self.slack) & (least < np.inf)[:, None]
        low = np.where(open_, far - reach[:, None], np.inf).min(0) - self.slack
        high = np.where(open_, far + reach[:, None], -np.inf).max(0) + self.slack
        return open_.any(0), low, high


def _pack(size: int, by_pivot: bool):
    """Consecutive rows ``(part, pivot, label, d, id, v)`` as blocks of up to ``size``, of one pivot each if ``by_pivot``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        k = 0

        def row() -> pa.RecordBatch:
            nonlocal k
            part, pivots, labels, d, ids, v = zip(*held)
            at = (int(part[0]) << 32) + k
            k += 1
            values = [at, sorted(set(pivots)), min(labels), max(labels), min(d), max(d), len(ids), list(ids), list(labels), _stack(list(v)).astype("<i4").tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["key", "pivots", "lmin", "lmax", "dmin", "dmax", "n", "ids", "labels", "vectors"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if held and (len(held) >= size or by_pivot and held[-1][1] != r[1]):
                    yield row()
                    held = []
                held.append(r)
        if held:
            yield row()

    return run


PACKED = f"key long, pivots array<int>, lmin long, lmax long, dmin double, dmax double, n long, {MEMBERS}"


def _best(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best ``ok`` scores of each row; ties go to the lesser id."""
    masked = np.where(ok, scores, -np.inf)
    n = masked.shape[1]
    least = np.partition(masked, n - k, axis=1)[:, n - k] if n > k else np.full(len(masked), -np.inf)
    i, j = np.nonzero((masked >= least[:, None]) & ok)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


class Mined:
    """The mined rows, and the tables that the searches have left in the workspace."""

    def __init__(self, rows: DataFrame, ws: Workspace, rounds: list[str], n_rows: int, n_anchors: int):
        self.rows, self.ws, self.rounds, self.n_rows, self.n_anchors = rows, ws, rounds, n_rows, n_anchors

    def shares(self) -> dict[str, float]:
        """For each search, the scored share of all pairs of an anchor and a row."""
        out: dict[str, float] = {}
        for name in self.rounds:
            n = self.ws.load(f"{name}-pairs").agg(F.sum("scored")).first()[0] or 0
            out[name.rpartition("-")[0]] = out.get(name.rpartition("-")[0], 0) + n / max(1, self.n_rows * self.n_anchors)
        return out


class _Join:
    """Groups of anchors against blocks of rows."""

    def __init__(self, ws: Workspace, groups: DataFrame, blocks: DataFrame, space):
        self.ws, self.groups, self.blocks, self.space, self.rounds = ws, groups, blocks, space, []

    def _pairs(self, asked: DataFrame, *, own: bool, k: int, same: bool) -> DataFrame:
        """``(g, b, scored)``: which group must meet which block. ``asked (key, goals)`` has each group's goals; see ``_goals``."""
        shared = self.space

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for r in batch.to_pylist():
                    ids, _, v = _members(r)
                    mine = set(r["pivots"])
                    if own:
                        at = np.array(sorted(mine))
                        low, high = np.full(len(at), -np.inf), np.full(len(at), np.inf)
                    else:
                        open_, low, high = shared.value.rings(v, _least(ids, r["goals"], k))
                        at = np.array([p for p in np.flatnonzero(open_) if p not in mine], np.int64)
                        low, high = low[at], high[at]
                    m = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * m, pa.int64()), pa.array([r["n"]] * m, pa.int64()), pa.array([r["lmin"]] * m, pa.int64()), pa.array([r["lmax"]] * m, pa.int64()), pa.array(at, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["g", "gn", "glow", "ghigh", "pivot", "low", "high"])

        goals = self.groups.join(asked, "key") if not own or not same else self.groups.withColumn("goals", F.lit(None).cast(GOALS))
        rings = goals.select("key", "pivots", "lmin", "lmax", "n", "ids", "labels", "vectors", "goals").mapInArrow(run, "g long, gn long, glow long, ghigh long, pivot int, low double, high double")
        held = self.blocks.select(F.col("key").alias("b"), F.col("pivots")[0].alias("pivot"), "lmin", "lmax", "dmin", "dmax", "n")
        ring = (F.col("dmin") <= F.col("high")) & (F.col("dmax") >= F.col("low"))
        one = (F.col("lmin") == F.col("lmax")) & (F.col("glow") == F.col("ghigh")) & (F.col("lmin") == F.col("glow"))
        label = (F.col("lmin") <= F.col("ghigh")) & (F.col("lmax") >= F.col("glow")) if same else ~one
        return rings.join(held, "pivot").where(ring & label).select("g", "b", (F.col("gn") * F.col("n")).alias("scored"))

    def search(self, name: str, asked: DataFrame | None, *, k: int, same: bool, own: bool, only_open: DataFrame | None = None) -> DataFrame:
        """Finds ``(g, anchor_id, slot, id, score)`` of the round, up to ``k`` per slot and share; ``slot`` is the positive's place, or 0."""
        ws = self.ws
        self.rounds.append(name)
        pairs = ws.save(self._pairs(asked, own=own, k=k, same=same), f"{name}-pairs")
        sizes = pairs.groupBy("g").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        dealt = pairs.join(sizes, "g").select("g", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
        left = dealt.join(self.blocks.withColumnRenamed("key", "b").select("b", "ids", "labels", "vectors"), "b").select("g", "share", "ids", "labels", "vectors")
        groups = self.groups.select(F.col("key").alias("g"), "ids", "labels", "vectors")
        groups = groups.join(asked.withColumnRenamed("key", "g"), "g") if asked is not None else groups.withColumn("goals", F.lit(None).cast(GOALS))
        right = dealt.select("g", "share").distinct().join(groups, "g").select(F.col("g").alias("rg"), F.col("share").alias("rshare"), "ids", "labels", "vectors", "goals")

        def run(blocks, group):
            import pyarrow as pa

            out: list[np.ndarray] = []
            for r in group.to_pylist():  # one row
                ids, labels, v = _members(r)
                slots = _slots(ids, r["goals"], same)
                held = [np.empty((0, 4), np.int64) for _ in slots]
                for x in range(blocks.num_rows):
                    b_ids, b_labels, b = _members({c: blocks.column(c)[x].as_py() for c in ("ids", "labels", "vectors")})
                    scores = _products(v, b)
                    fit = labels[:, None] == b_labels[None] if same else labels[:, None] != b_labels[None]
                    fit &= ids[:, None] != b_ids[None]
                    for s, (low, high) in enumerate(slots):
                        i, j = _best(scores, fit & (scores >= low[:, None]) & (scores <= high[:, None]), b_ids, k)
                        new = np.stack([i, np.full(len(i), s), b_ids[j], scores[i, j].astype(np.int64)], axis=1)
                        all_ = np.concatenate([held[s], new])
                        all_ = all_[np.lexsort((all_[:, 2], -all_[:, 3], all_[:, 0]))]
                        held[s] = all_[np.arange(len(all_)) - np.searchsorted(all_[:, 0], all_[:, 0]) < k]
                for h in held:
                    out.append(np.concatenate([np.full((len(h), 1), r["rg"]), ids[h[:, :1]], h[:, 1:]], axis=1))
            rows = np.concatenate(out) if out else np.empty((0, 5), np.int64)
            return pa.table({c: pa.array(rows[:, x], pa.int64()) for x, c in enumerate(("g", "anchor_id", "slot", "id", "score"))})

        found = left.groupBy("g", "share").cogroup(right.groupBy("rg", "rshare")).applyInArrow(run, "g long, anchor_id long, slot long, id long, score long")
        return ws.save(_top(found, k), name)


#: Of a group: per anchor and slot the bounds of wanted scores, and the scores found so far that bound the rest.
GOALS = "array<struct<anchor_id:bigint,slot:bigint,low:bigint,high:bigint,found:array<bigint>>>"


def _least(ids: np.ndarray, goals: list | None, k: int) -> np.ndarray:
    """The least score with which a further row could still count for each anchor; infinite if none can."""
    least = np.full(len(ids), np.inf)
    at = {int(x): i for i, x in enumerate(ids)}
    for g in goals or []:
        if g["low"] is None or g["low"] <= g["high"]:
            full = sorted(g["found"] or [], reverse=True)[:k]
            floor = -np.inf if g["low"] is None else g["low"]
            least[at[g["anchor_id"]]] = min(least[at[g["anchor_id"]]], full[-1] if len(full) == k else floor)
    return least


def _slots(ids: np.ndarray, goals: list | None, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per slot, every anchor's bounds; one open slot for positives."""
    if same:
        return [(np.full(len(ids), -np.inf), np.full(len(ids), np.inf))]
    at = {int(x): i for i, x in enumerate(ids)}
    out = [(np.full(len(ids), np.inf), np.full(len(ids), -np.inf)) for _ in range(1 + max([g["slot"] for g in goals or []], default=-1))]
    for g in goals or []:
        low, high = out[g["slot"]]
        low[at[g["anchor_id"]]], high[at[g["anchor_id"]]] = g["low"], g["high"]
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("g", "anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _goals(rows: DataFrame) -> DataFrame:
    """``(key, goals)`` of rows ``(g, anchor_id, slot, low, high, found)``: as many per group as it has anchors and slots."""
    one = F.struct("anchor_id", "slot", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("found").cast("array<long>").alias("found"))
    return rows.groupBy(F.col("g").alias("key")).agg(F.collect_list(one).alias("goals"))


def mine(vectors: DataFrame, ws: Workspace, *, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> Mined:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` tells the anchors among ``vectors``.  A negative's score lies
    between ``low`` and ``high`` hundredths of its positive's.
    """
    spark = vectors.sparkSession
    rows = ws.save(quantised(vectors, anchor, scale=scale, id_col=id_col, label_col=label_col, vector_col=vector_col), "rows")
    n_rows, n_anchors, m2 = rows.agg(F.count("*"), F.count_if("anchor"), F.max("n2")).first()
    sample = [bytes(r.v) for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()]
    space = spark.sparkContext.broadcast(_Space(sample or [b""], m2 or 0))

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                v = _stack(batch.column(3).to_pylist()).astype(np.float64)
                n2, asks = batch.column(4).to_numpy().astype(np.float64), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
                far, far_asked = space.value.of_rows(v, n2), space.value.of_anchors(v)
                at = far.argmin(1)
                own = np.where(asks, far_asked.argmin(1), -1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(2), pa.array(far[np.arange(len(at)), at]), batch.column(0), batch.column(3), pa.array(own, pa.int32())], ["pivot", "label", "d", "id", "v", "own"])

    placed = ws.save(rows.select("id", "anchor", "label", "v", "n2").mapInArrow(assign, "pivot int, label long, d double, id long, v binary, own int"), "placed")
    part = F.spark_partition_id().alias("part")

    def packed(of: DataFrame, order: list[str], parts: int, size: int, by_pivot: bool, name: str) -> DataFrame:
        dealt = of.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return ws.save(dealt.select(part, "pivot", "label", "d", "id", "v").mapInArrow(_pack(size, by_pivot), PACKED), name)

    blocks = packed(placed, ["pivot", "label", "d", "id"], max(shuffle_parts(spark), n_rows // (16 * BLOCK)), BLOCK, True, "blocks")
    asking = placed.where("own >= 0").select(F.col("own").alias("pivot"), "label", "d", "id", "v")
    groups = packed(asking, ["label", "pivot", "id"], max(8, n_anchors // (4 * GROUP)), GROUP, False, "groups")

    join = _Join(ws, groups, blocks, space)
    first = join.search("positives-near", None, k=positives, same=True, own=True)
    members = groups.select(F.col("key").alias("g"), F.explode("ids").alias("anchor_id"))
    so_far = first.groupBy("g", "anchor_id").agg(F.collect_list("score").alias("found"))
    open_ = members.join(so_far, ["g", "anchor_id"], "left").select("g", "anchor_id", F.lit(0).cast("long").alias("slot"), F.lit(None).alias("low"), F.lit(None).alias("high"), "found")
    second = join.search("positives-far", _goals(open_), k=positives, same=True, own=False)
    found = ws.save(_top(first.unionByName(second).drop("rank"), positives), "positives")

    # ceil(low * score / 100) and floor(high * score / 100), in whole numbers.
    ps = F.col("score")
    windows = found.select("g", "anchor_id", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), ps.alias("positive_score"), (-_floor_div(-ps * low, 100)).alias("low"), _floor_div(ps * high, 100).alias("high"))
    windows = ws.save(windows, "windows")
    near = join.search("negatives-near", _goals(windows.withColumn("found", F.lit(None))), k=negatives, same=False, own=True)
    so_far = near.groupBy("g", "anchor_id", "slot").agg(F.collect_list("score").alias("found"))
    far = join.search("negatives-far", _goals(windows.join(so_far, ["g", "anchor_id", "slot"], "left")), k=negatives, same=False, own=False)
    best = _top(near.unionByName(far).drop("rank"), negatives)
    out = best.join(windows, ["g", "anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return Mined(out, ws, join.rounds, n_rows, n_anchors)


def _floor_div(x: Column, n: int) -> Column:
    size = F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, size), size)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), Workspace(spark, "negatives"), anchor=F.col("vec_id") % 50 == 0).rows


#: DuckDB SQL of the query, by every pair.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, s AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, id)::INT AS rank,
       id AS negative_id, positive_score, s AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY rank <= 3
"""
