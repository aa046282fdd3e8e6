"""Files written by the tasks that hold the rows: one file for each part of a table
and a bounded number of rows, so no table passes one process."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WRITTEN = "file string, rows long"


def place_of(path: str) -> tuple:
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def put_whole(store, path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written under a name of the attempt, then renamed."""
    base, name = path.rsplit("/", 1)
    hidden = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    store.move(hidden, path)


def write_parts(df: DataFrame, folder: str, suffix: str, encode: Callable[[pa.Table], bytes], rows_per_file: int = 1 << 18, by: str | None = None) -> DataFrame:
    """``encode(rows)`` as files in ``folder``, a path or URI that every executor
    reaches: file, rows. Names come from the partition, so a task that is run again, or
    twice at a time, replaces its files by equal ones; each is renamed when whole, and
    hidden before. With ``by``, a column of names whose rows lie together, there is a file
    for each name instead, which must fit in a task. Nothing is written until the result is asked for; ask once, and
    count only the files that it lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place_of(folder)
        store.create_dir(base, recursive=True)
        part, held, n, done, key = TaskContext.get().partitionId(), [], 0, [], None

        def put() -> None:
            nonlocal held, n
            name = f"part-{part:05d}-{len(done):03d}.{suffix}" if by is None else f"{key.rsplit('.', 1)[0]}.{suffix}"
            put_whole(store, f"{base}/{name}", encode(pa.Table.from_batches(held)))
            done.append((name, n))
            held, n = [], 0

        for b in batches:
            if by is not None:
                names = b.column(by).to_pylist()
                for i in [0, *(k for k in range(1, len(b)) if names[k] != names[k - 1])] if len(b) else ():
                    if n and names[i] != key:
                        put()
                    upto = next((k for k in range(i, len(b)) if names[k] != names[i]), len(b))
                    key, n = names[i], n + upto - i
                    held.append(b.slice(i, upto - i))
                continue
            at = 0
            while at < len(b):
                take = b.slice(at, min(rows_per_file - n, len(b) - at))
                held.append(take)
                n, at = n + len(take), at + len(take)
                if n == rows_per_file:
                    put()
        if n:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["file", "rows"])

    return df.mapInArrow(run, WRITTEN)
