"""Tables that cut the lineage between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class Workspace:
    """A folder of Parquet tables below ``spark.checkpoint.dir``, which driver and executors share; it goes when the driver ends.

    Where the setting is absent and Spark runs on this machine alone, as in
    tests, a temporary folder serves.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            if not _LOCAL:
                _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
            root = _LOCAL[0]
        self.path = f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it read back."""
        df.write.parquet(f"{self.path}/{name}")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")
