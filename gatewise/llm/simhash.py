"""Operator 1: SimHash near-dedup by tiled exact comparison.

Fingerprints go into tiles of one population count; inside and between tiles numpy
compares them by exclusive-or and bit counts, and pairs of tiles whose population
counts differ beyond the radius are skipped. Which fingerprints can meet at all follows from
the radius: of PARTS parts of the bits, two fingerprints within radius 3 agree
in two at least, so tiles are formed apart for each choice of two parts and
value of these (an exact rule: no pair within the radius is missed). Equal
fingerprints count once; links become classes by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS = 3
#: First bit and number of bits of each part.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of a tile; buckets with more are split by population count and, where
#: one count has more than SLICE, in slices.
TILE = 2048
SLICE = 16


def shingle_hashes(words: list[bytes], size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle, repeats included."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(text, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return np.array([h(text[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    lower = bytes(common.LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.utf8(batch.column("text"))
            buf = memoryview(data)
            # bytes.split() parts at 0x20 and 0x09 to 0x0D
            out = [fingerprint(shingle_hashes(bytes(buf[a:b]).translate(lower).split(), size)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("xx"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "xx", "fp"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, root) of the classes that the links a-b make."""
    verts, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(verts)), at.reshape(2, -1)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(verts))
    return verts[other], verts[root[other]]


def links(tile: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Class edges within each run of equal ``tile``, in which rows come by ``side``,
    then by population count. ``side``: 0 for a bucket that is compared within,
    but for counts that differ beyond the radius; 1 and 2 where only pairs across
    the sides count."""
    pop = np.bitwise_count(fp.view(np.uint64)).astype(np.int8)
    n, ends = len(fp), np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
    last = np.repeat(ends, np.diff(np.append(0, ends)))  # end of each row's run
    found, held = [], 0
    at, d = np.arange(n), 0
    while len(at):
        d += 1
        at = at[at + d < last[at]]
        # Counts ascend: beyond the radius all that follow are skipped.
        at = at[(pop[at + d] - pop[at] <= radius) | (side[at] != 0)]
        near = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= radius
        i = at[near]
        i = i[(side[i] == 0) | (side[i] != side[i + d])]
        if len(i):
            found.append((fp[i], fp[i + d]))
            held += len(i)
        if held > 1 << 20:
            found = [forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))]
            held = len(found[0][0])
    if not found:
        return fp[:0], fp[:0]
    return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("tile", "fp", "side"))]
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left")) if len(cols[0]) else 0
            kept = [c[cut:] for c in cols]  # the last tile may go on
            if cut:
                yield _edges(*links(*(c[:cut] for c in cols), radius))
        if len(kept[0]):
            yield _edges(*links(*kept, radius))

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b that join exactly the distinct fingerprints ``fp`` (long) which
    chains of links within ``radius`` join."""
    if radius > 3:
        raise ValueError("PARTS are laid out for a radius of 3 at most")
    value = {k: F.call_function("shiftrightunsigned", F.col("fp"), F.lit(at)).bitwiseAND(F.lit((1 << n) - 1)) for k, (at, n) in enumerate(PARTS)}
    chosen = [F.xxhash64(F.lit(i), value[j], value[k]) for i, (j, k) in enumerate(combinations(range(len(PARTS)), len(PARTS) - RADIUS))]
    rows = prints.select("fp", F.explode(F.array(*chosen)).alias("bucket"))
    big = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    big = common.saved(big, "big")
    # Few buckets hold over TILE rows: at most 1 / TILE of all rows.
    rows = common.join_groups(rows, big, ["bucket"], "n")
    whole = rows.filter("n is null").select(F.col("bucket").alias("tile"), "fp", F.lit(0).cast("long").alias("side"))
    # In a large bucket, tiles by population count and slice; pairs of tiles whose
    # counts differ by more than the radius don't meet.
    pop, n_slices = F.bit_count("fp"), F.ceil(F.col("n") / (SLICE * TILE)).cast("int")
    split = rows.filter("n is not null").select("bucket", "fp", pop.alias("pop"), F.pmod(F.xxhash64("fp"), n_slices).cast("int").alias("slice"), n_slices.alias("slices"))
    other = split.withColumn("pop2", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius))).withColumn("slice2", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    mine, its = F.struct("pop", "slice"), F.struct(F.col("pop2").alias("pop"), F.col("slice2").alias("slice"))
    pair = F.xxhash64("bucket", F.least(mine, its), F.greatest(mine, its))
    side = F.when(mine == its, 0).when(mine < its, 1).otherwise(2).cast("long")
    tiles = whole.unionByName(other.select(pair.alias("tile"), "fp", side.alias("side")))
    parts = tiles.repartition("tile").sortWithinPartitions("tile", "side", F.bit_count("fp"), "fp")
    return parts.mapInArrow(common.lean(_compare(radius)), "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id
    (smallest id that links reach) and near (whether it links to another fingerprint).

    Fingerprints link at ``radius`` differing bits or fewer. Null and empty texts
    have fingerprint 0; null ids belong to classes but name none (component_id
    is null where no other id is there); repeated rows are repeated; texts of any
    length are read whole; other columns are ignored; an empty table gives no rows.
    """
    out = _classes(docs, radius, size, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.id").alias("component_id"), "near")


def without_near_copies(docs: DataFrame, radius: int = RADIUS, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that name their class: one of each, that with the
    smallest id; a null id stays only where no other is there. Of rows that
    repeat id and text one stays, of ids that repeat with other texts the one with
    the smaller hash. Null and empty texts are one class; an empty table stays so.
    """
    out = _classes(docs, radius, size, id_col, text_col)
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("xx").cast("string"))
    kept = F.struct("id", "xx").eqNullSafe(F.col("component").dropFields("other"))
    return common.kept_rows(docs, out.select(key.alias("key"), kept.alias("kept")), id_col, text_col)


def _classes(docs: DataFrame, radius: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, xx (hash of the text), fp, near, and component: the least id of the
    class (not null if there is one) and its text's hash."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("xx", F.xxhash64("text"))
    kind = src.schema["id"].dataType.simpleString()
    rows = common.saved(src.mapInArrow(common.lean(_fingerprints(size)), f"id {kind}, xx long, fp long"), "fingerprints")
    name = F.struct(F.col("id").isNull().alias("other"), "id", "xx")  # null ids come last
    prints = common.saved(rows.groupBy("fp").agg(F.min(name).alias("first"), F.count("*").alias("n")), "prints")
    roots = common.components(near_links(prints, radius))
    linked = common.saved(prints.join(roots, prints.fp == roots.v).select("fp", "root", "first", "n"), "linked")
    least = common.saved(linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("members")), "least")
    named = common.join_groups(linked.select("root", "fp"), least, ["root"], "members").select("fp", "component")
    table = prints.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component"), F.col("component").isNotNull().alias("near"))
    return common.join_groups(rows, common.saved(table, "classes"), ["fp"], "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_simhash over the whole of ``documents``."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
