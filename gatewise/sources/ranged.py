"""Byte ranges of files, read by the tasks that need them.

Spark lists the files (``binaryFile`` without content); tasks open them through
pyarrow's file systems (local, HDFS, S3, GCS, Azure). A file of any size is so
read by many tasks, and of it only what they ask for.
"""

from __future__ import annotations

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession

from .parts import place_of

#: Bytes that a small read fetches at least, as its neighbours are often next.
WINDOW = 1 << 12
#: Bytes that a task reads, and the gap between two ranges that it reads across.
PART_BYTES, GAP = 1 << 25, 1 << 16


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and length of the files that a path or pattern names."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def short(path: str) -> str:
    return path.rsplit("/", 1)[-1]


class Ranged:
    """A file to be sliced like bytes: a slice reads its own range, or comes from the
    window read last. ``counted`` sums up the bytes read."""

    def __init__(self, path: str, window: int = WINDOW, counted: Accumulator | None = None):
        store, base = place_of(path)
        self.file = store.open_input_file(base)
        self.size = self.file.size()
        self.window, self.counted = window, counted
        self.at, self.kept = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if not self.at <= start <= stop <= self.at + len(self.kept):
            n = max(stop - start, min(self.window, self.size - start))
            data = self.file.read_at(n, start)
            if self.counted is not None:
                self.counted.add(len(data))
            if n > self.window:  # a large range isn't asked for again
                return data
            self.at, self.kept = start, data
        return self.kept[start - self.at : stop - self.at]
