"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Tables written to the folder that driver and executors share.

    A written table cuts the lineage: losing an executor costs no more than
    the tasks that ran on it.  The folder is ``spark.checkpoint.dir``; where
    that is unset and Spark runs on this machine alone, as in tests, a temporary
    folder serves.  Tables are deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or _local_root(spark)
        self.path = f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
        self._file_system().deleteOnExit(self._hadoop_path())

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return it read back."""
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._file_system().delete(self._hadoop_path(f"/{name}"), True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs, which stay until the driver's collector finds that nothing refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _hadoop_path(self, below: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + below)

    def _file_system(self):
        return self._hadoop_path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


_LOCAL: list[str] = []


def _local_root(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_LOCAL[0]}"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
