"""Consecutive points of the n-dimensional curve as a data source, for Python and for SQL.

    CREATE TEMPORARY VIEW walk USING curve_walk OPTIONS (dims 3, bits 10, start 12345, count 1000000)

Its partitions are ranges of indexes; each task replays its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orbweave.errors import IndexOutOfRange

#: Points of a task, of which at most MOST_TASKS are planned, and of an Arrow batch.
ROWS_PER_TASK, MOST_TASKS, ROWS_PER_BATCH = 1 << 22, 100_000, 1 << 16


@dataclass
class _Stretch(InputPartition):
    start: int
    count: int


class CurveWalkSource(DataSource):
    """Options: dims, bits, start (0), count (all there is), rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "curve_walk"

    def _space(self) -> tuple[int, int]:
        from orbweave.functions.curve import check_space

        dims, bits = int(self.options["dims"]), int(self.options["bits"])
        check_space(dims, bits)
        return dims, bits

    def schema(self) -> str:
        from orbweave.functions.curve import index_kind

        return f"index {index_kind(*self._space())}, point array<long>"

    def reader(self, schema) -> DataSourceReader:
        dims, bits = self._space()
        start = int(self.options.get("start", 0))
        count = int(self.options.get("count", (1 << dims * bits) - start))
        if start < 0 or count < 0 or start + count > 1 << dims * bits:
            raise IndexOutOfRange(f"{start} + {count}")
        return _WalkReader(dims, bits, start, count, int(self.options.get("rows_per_task", ROWS_PER_TASK)))


class _WalkReader(DataSourceReader):
    def __init__(self, dims: int, bits: int, start: int, count: int, rows: int):
        self.dims, self.bits, self.start, self.count = dims, bits, start, count
        self.rows = max(1, rows, -(-count // MOST_TASKS))

    def partitions(self) -> list[InputPartition]:
        return [_Stretch(self.start + at, min(self.rows, self.count - at)) for at in range(0, self.count, self.rows)] or [_Stretch(self.start, 0)]

    def read(self, partition: _Stretch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from orbweave.functions.curve import index_kind, walk_array
        from orbweave.functions.vectors import hex_text, lists

        for at in range(0, partition.count, ROWS_PER_BATCH):
            start, n = partition.start + at, min(ROWS_PER_BATCH, partition.count - at)
            points = lists(walk_array(start, n, self.dims, self.bits).T, pa.int64())
            if index_kind(self.dims, self.bits) == "long":
                index = pa.array(np.arange(start, start + n, dtype=np.int64))
            else:
                low = np.arange(n, dtype=np.uint64) + np.uint64(start & (1 << 64) - 1)
                high = np.uint64(start >> 64) + (low < np.uint64(start & (1 << 64) - 1)).astype(np.uint64)
                index = pa.array(hex_text(high, low, -(-self.dims * self.bits // 4)), pa.string())
            yield pa.RecordBatch.from_arrays([index, points], ["index", "point"])
