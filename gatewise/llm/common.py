"""Shared helpers of the training-data operators: saved tables, joins against
groups of any size, ranks and running sums without a one-task group, a
repeat filter of bounded size, connected components, and Arrow text access."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.store import deleted, new_path, saved, shared_dir

__all__ = ["deleted", "new_path", "saved", "shared_dir"]

#: Groups beyond the HOT_GROUPS largest hold under 1 / HOT_GROUPS of the rows
#: each, so an ordinary shuffle join handles them; the largest are broadcast.
HOT_GROUPS = 512
HOT_LEAST = 64
#: Words of FILTER_BITS bits of a repeat filter: a word for each FILTER_KEYS keys, but
#: 2 ** 12 (about 64 KB broadcast) at least and 2 ** 21 (about 32 MB) at most.
FILTER_BITS, FILTER_KEYS = 63, 8
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 21
#: Ranges of a hashed order within a group for ranks and running sums.
RANGES = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Left join of ``rows`` with one row per key in ``groups``; ``n`` holds the
    number of rows of each key. Keys are not null. Both should be saved tables.

    The at most HOT_GROUPS largest groups are broadcast, which deals their rows
    where they lie; all other groups are joined by a shuffle.
    """
    hot = groups.filter(F.col(n) > HOT_LEAST).orderBy(F.desc(n), *keys).limit(HOT_GROUPS)
    hot = F.broadcast(saved(hot, "hot"))
    at_hot = rows.join(hot, keys, "inner")
    cold_rows = rows.join(hot.select(*keys), keys, "left_anti")
    cold = groups.join(hot.select(*keys), keys, "left_anti")
    return at_hot.unionByName(cold_rows.join(cold, keys, "left"))


class RepeatFilter(NamedTuple):
    words: DataFrame
    size: int


def repeat_filter(keys: DataFrame, key: Column, least: int = 2) -> RepeatFilter:
    """A bit set: buckets of ``key`` (a long) with ``least`` rows or more. Sized by the
    rows of the saved table ``keys``, within a bound that is safe to broadcast; a
    fuller set only lets more rows through."""
    size = LEAST_WORDS
    n = keys.count()
    while size < MOST_WORDS and size * FILTER_KEYS < n:
        size *= 2
    bucket = F.pmod(key, F.lit(size * FILTER_BITS))
    seen = keys.select(bucket.alias("b")).groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    word = F.floor(F.col("b") / FILTER_BITS).cast("long")
    bit = F.pmod(F.col("b"), F.lit(FILTER_BITS)).cast("int")
    words = seen.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_mask"))
    return RepeatFilter(saved(words, "filter"), size)


def flagged(rows: DataFrame, found: RepeatFilter, key: Column, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: whether the bucket of ``key`` is in the set."""
    bucket = F.pmod(key, F.lit(found.size * FILTER_BITS))
    bit = F.pmod(bucket, F.lit(FILTER_BITS)).cast("int")
    on = rows.withColumn("_word", F.floor(bucket / FILTER_BITS).cast("long")).join(F.broadcast(found.words), "_word", "left")
    hit = F.coalesce(F.call_function("getbit", F.col("_mask"), bit) == 1, F.lit(False))
    return on.withColumn(name, hit).drop("_word", "_mask")


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and a hash of its text."""
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string")
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)


def kept_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, whole, whose key has a kept row in ``verdict`` (key,
    kept); of rows that repeat id and text one stays.

    Rows that a filter of the others' keys clears pass where they lie; only the
    rest is shuffled. Null ids and texts have keys of their own.
    """
    keys = verdict.groupBy("key").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    touched = saved(keys.filter("not stays or n > 1"), "touched")
    words = repeat_filter(touched, F.xxhash64("key"), 1)
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    rows = flagged(rows, words, F.xxhash64("key"), "touched")
    calm = rows.filter("not touched").select("row.*")
    rest = rows.filter("touched").select("row", "key").groupBy("key").agg(F.first("row").alias("row"))
    rest = rest.join(touched.filter("not stays").select("key"), "key", "left_anti")
    return calm.unionByName(rest.select("row.*"))


def running(rows: DataFrame, group: str, order: Column, ties: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with long ``name``: the sum of ``value`` over the rows of the same
    ``group`` (not null) that come before, ordered by the hash ``order`` and ``ties``.

    Two levels: hashes fall into RANGES ranges; sums run inside each range, and
    the ranges' totals (at most RANGES per group) are summed ahead of them. No
    task needs a whole group.
    """
    span = (1 << 32) // RANGES
    h = F.call_function("shiftrightunsigned", order, F.lit(32))
    at = rows.withColumn("_h", order).withColumn("_range", F.floor(h / span).cast("int")).withColumn("_v", value.cast("long"))
    totals = at.groupBy(group, "_range").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(group, "_range").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = at.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    out = out.join(totals, [group, "_range"])
    return out.withColumn(name, F.col("_ahead") + F.col("_in")).drop("_h", "_range", "_v", "_in", "_ahead")


def components(edges: DataFrame) -> DataFrame:
    """Columns v, root: for each end of ``edges`` (long a, long b) the smallest
    vertex it reaches. Alternating large and small stars: the edges never grow
    in number, each round is two aggregations and joins of narrow rows, and
    rounds go on until one changes nothing (some log n squared at most)."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "edges")
    mark = None
    while True:
        both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_groups(both.filter("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a").select("a", F.col("m").alias("b")))
        large = saved(large.filter("a <> b").distinct(), "large")
        down = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "down")
        small = join_groups(large, down, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = saved(small.filter("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)


# ---- Arrow text access, used inside mapInArrow --------------------------------


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Functions whose results stay with a worker from task to task.
_KEPT: list = []


def kept(f: Callable) -> Callable:
    """``f`` with results that a worker keeps until a task starts that doesn't use them."""
    f = functools.cache(f)
    _KEPT.append(f)
    return f


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: Callable | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that lets go what workers keep of other stages (all ``kept`` but what
    it ``uses``) and releases memory at the end of each task: workers live on, and
    what one stage has freed would stay with them through all that follow."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _KEPT:
            if f is not uses:
                f.cache_clear()
        yield from run(batches)
        release()

    return wrapped


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null reads as empty."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offs


def chunks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, so that numpy work on a batch
    stays small; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Bytes that end a word: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multiplier of the word hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(step)
        k, step = k + m, step * step % (1 << 64)
    return out[:n]


_POW: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = powers(base, max(n, (1 << 20) + 1))
        if len(have) <= 1 << 22:
            _POW[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of non-space bytes) and each word's row."""
    lo = int(offs[0])
    buf = data[lo : int(offs[-1])]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[buf]
    step = np.diff(inside)
    cut = (offs[1:-1] - lo).astype(np.int64)
    cut = cut[(cut > 0) & (cut < len(buf))]
    joined = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])  # words that touch across two rows
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    row = np.searchsorted(offs - lo, starts, side="right") - 1
    return starts, ends, row


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running polynomial sums."""
    n = len(buf)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power_table(BASE, n), out=run[1:])
    h = (run[ends] - run[starts]) * power_table(BASE_INV, n + 1)[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


