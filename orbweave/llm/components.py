"""Connected components of an edge table, by alternating stars.

Edges are first contracted within each batch: every node of a batch is linked to
the least one that the batch's edges reach, which shortens chains.  Each round
then links every node's larger neighbours to its smallest neighbour, then
its smaller ones likewise, until nothing changes; the number of rounds grows
with the logarithm of the longest chain.  Whatever is joined has been written
before, so a node with a third of all edges is a skewed join of two scans,
which adaptive execution splits; no node's neighbours are gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the groups of i and j; labels are least members, compressed. Returns which pairs were needed."""
    needed = []
    at = np.arange(len(i))
    while len(at):
        a, b = label[i[at]], label[j[at]]
        open_ = a != b
        at, a, b = at[open_], a[open_], b[open_]
        high, first = np.unique(np.maximum(a, b), return_index=True)  # each group hooks onto one lower group
        label[high] = np.minimum(a, b)[first]
        needed.append(at[first])
        while (label[label] != label).any():
            label[:] = label[label]
    return np.concatenate(needed) if needed else at


def _contract(batches: Iterator) -> Iterator:
    """Edges ``(a, b)`` of different ends: each node of a batch and the least one that its edges reach there."""
    import pyarrow as pa

    for batch in batches:
        ends = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = np.arange(len(nodes))
        merge_labels(label, at[: len(ends[0])], at[len(ends[0]) :])
        other = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["u", "v"])


def connected_components(edges: DataFrame, ws: Workspace, tag: str = "cc") -> DataFrame:
    """``(node, root)`` for each end of ``edges (a, b)``; root is the least node reachable.

    Self-loops count as nodes without links; null ends are left out.
    """
    edges = edges.where("a is not null and b is not null")
    loops = ws.save(edges.where("a = b").select(F.col("a").alias("node")).distinct(), f"{tag}-loops")
    two = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    star = ws.save(two.mapInArrow(_contract, "u long, v long").distinct(), f"{tag}-0")
    before, k = None, 0
    while (now := tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before:
        before, k = now, k + 1
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-least{k}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.save(large, f"{tag}-large{k}")
        first = ws.save(large.groupBy("u").agg(F.min("v").alias("v")), f"{tag}-first{k}")
        small = large.join(first.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = ws.save(first.unionByName(small).distinct(), f"{tag}-{k}")
        ws.drop(f"{tag}-{k - 1}", f"{tag}-least{k}", f"{tag}-large{k}", f"{tag}-first{k}")
    ends = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = star.select(F.col("v").alias("node")).unionByName(loops).distinct().join(ends, "node", "left_anti")
    return ws.save(ends.unionByName(roots.select("node", F.col("node").alias("root"))), f"{tag}-components")
