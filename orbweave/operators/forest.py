"""Approximate neighbours by a forest of sorted hash keys.

Each ``hk2`` table is a prefix tree whose depth-first order is the order of its
keys: the rows beside a query's place share its longest prefixes, however many
rows there are.  A search takes ``reach`` rows on either side in every tree,
so a query has ``2 * reach * tables`` candidates at most at any size of the
table, where buckets of a fixed number of bits would fill up with it.

Places are exact: entries are sorted by range, counted within partitions, and
moved up by the counts before them.  A query then meets the rows around its
place by an equi-join on stretches of ``2 * reach`` places, which no key can skew.
The search is approximate; ``nearest.pruned_topk`` and ``retrieval.exact_topk``
are the exact ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import lsh
from orbweave.functions.unsigned import sortable
from orbweave.workspace import Workspace


def _entries(rows: DataFrame, name: str, space: lsh.Tables, kind: int) -> DataFrame:
    keys = rows.where("embedding is not null").select(F.col(name).cast("long").alias("id"), lsh.keys("embedding", space, invalid="null").alias("keys"))
    return keys.select(F.lit(kind).alias("kind"), "id", F.posexplode("keys").alias("t", "key")).select("t", sortable("key").alias("key"), "kind", "id")


def _count(batches: Iterator) -> Iterator:
    """Of sorted ``(part, t, kind, id)``: how many rows of the tree lie before each entry in its partition, queries not counted."""
    import pyarrow as pa

    last, before = -1, 0
    for batch in batches:
        t, kind = (batch.column(c).to_numpy() for c in (1, 2))
        at = np.empty(len(t), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(t)) + 1), len(t)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                before = before if t[a] == last else 0
                seen = np.cumsum(kind[a:b])
                at[a:b] = before + seen - kind[a:b]
                last, before = int(t[a]), before + int(seen[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["part", "t", "kind", "id", "at"])


def candidates(queries: DataFrame, data: DataFrame, *, reach: int, space: lsh.Tables) -> DataFrame:
    """Distinct ``(query_id, id)``: of ``data (id, embedding)``, the ``reach`` rows before and after each of
    ``queries (query_id, embedding)`` in every tree.

    Rows of one key come in the order of their ids, and a query before all of
    its own key.  Null, zero and non-finite embeddings have no place.
    """
    spark = data.sparkSession
    ws = Workspace(spark, "forest")
    both = _entries(queries, "query_id", space, 0).unionByName(_entries(data, "id", space, 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = ["t", "key", "kind", "id"]
    dealt = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    counted = dealt.select(F.spark_partition_id().alias("part"), "t", "kind", "id").mapInArrow(_count, "part int, t int, kind int, id long, at long")
    counted = ws.save(counted, "counted")

    sizes = counted.groupBy("t", "part").agg(F.sum("kind").alias("n"))  # a row per partition, and one more per tree
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("t", "part", earlier.alias("offset"))
    placed = counted.join(offsets, ["t", "part"]).select("t", "kind", "id", (F.col("at") + F.col("offset")).alias("place"))
    width = 2 * reach
    stretch = lambda c: F.floor(c / width)
    held = placed.where("kind = 1").select("t", "id", "place", stretch(F.col("place")).alias("stretch"))
    low = F.col("place") - reach
    asked = placed.where("kind = 0").select("t", F.col("id").alias("query_id"), low.alias("low"), F.explode(F.sequence(stretch(low), stretch(low + width - 1))).alias("stretch"))
    met = asked.join(held, ["t", "stretch"]).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width))
    return met.select("query_id", "id").distinct()
