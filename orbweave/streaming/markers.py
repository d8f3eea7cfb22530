"""Markers over a stream of embedding lines.

The map itself is stateless, so any output mode and trigger fits.  ``keep_stream``
writes it so that a bad line stops nothing and a crash leaves nothing half
done: every micro-batch has folders of its own for good and bad rows, which a
second attempt overwrites, and counts only once its mark is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import lsh, markers
from orbweave.sources.lines import read_embeddings


def stream_markers(spark: SparkSession, path: str, *, space: markers.Space = markers.Space(), width: int | None = None) -> DataFrame:
    """A streaming ``(id, id_json, kind, marker, error)`` of the files that arrive under ``path``; rows in error have no marker."""
    rows = read_embeddings(spark, path, width=width, stream=True)
    return rows.select("id", "id_json", "kind", F.when(F.col("error").isNull(), markers.marker("embedding", space, invalid="null")).alias("marker"), "error")


def stream_keys(spark: SparkSession, path: str, *, space: lsh.Tables = lsh.Tables(), width: int | None = None) -> DataFrame:
    """The same with one hash key per table."""
    rows = read_embeddings(spark, path, width=width, stream=True)
    return rows.select("id", "id_json", "kind", F.when(F.col("error").isNull(), lsh.keys("embedding", space, invalid="null")).alias("keys"), "error")


def keep_stream(rows: DataFrame, out: str, checkpoint: str, **trigger):
    """Start a query that writes a stream with an ``error`` column below ``out``: ``good``, ``bad`` and ``marks``, by batch.

    ``trigger`` is passed on, as ``availableNow=True``.  Read with ``kept``.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for name, part in (("good", batch.where("error is null").drop("error")), ("bad", batch.where("error is not null"))):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
            mark = batch.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad"))
            mark.write.mode("overwrite").parquet(f"{out}/marks/batch={n}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def kept(spark: SparkSession, out: str, name: str = "good") -> DataFrame:
    """The ``good`` or ``bad`` rows of finished batches."""
    marks = spark.read.parquet(f"{out}/marks").select("batch")
    return spark.read.parquet(f"{out}/{name}").join(marks, "batch", "left_semi").drop("batch")
