"""Operator 10: exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is the value of its bytes as a polynomial; that of a text
is the sum of its chunks' fingerprints, each shifted by the length that follows,
so chunks can be hashed anywhere and summed in any order. Texts of equal length
and fingerprint are then compared chunk by chunk as streams: the least and the
greatest chunk at each place of a class must be the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Two primes under 2 ** 31 and a base for each.
MODULI = ((2147483647, 1103515245), (2147483629, 1566083941))
#: Bytes of a chunk that is hashed at once, and of a compared chunk.
CHUNK = 1 << 16
COMPARED = 1 << 14
#: Bytes above which a text is dealt out in chunks of as many, hashed anywhere.
HUGE = CHUNK
KEYS = ["fp_bytes", "fp_1", "fp_2"]


def chunk_value(chunk: np.ndarray, base: int, mod: int, table: dict) -> int:
    """Value of at most CHUNK bytes at ``base`` modulo ``mod``; the first byte has
    the highest power. Bytes count from 1, so that leading zeros matter."""
    if (base, mod) not in table:
        p = [1]
        for _ in range(CHUNK - 1):
            p.append(p[-1] * base % mod)
        table[base, mod] = np.array(p[::-1], np.uint64)
    w = table[base, mod][CHUNK - len(chunk) :]
    return int(np.dot(chunk.astype(np.uint64) + np.uint64(1), w) % np.uint64(mod))


def fingerprint(data: np.ndarray, base: int, mod: int, table: dict) -> int:
    """Value of any number of bytes, chunk by chunk."""
    value = 0
    for i in range(0, len(data), CHUNK):
        chunk = data[i : i + CHUNK]
        value = (value * pow(base, len(chunk), mod) + chunk_value(chunk, base, mod, table)) % mod
    return value


def _hash(moduli, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            data, offs = common.utf8(batch.column("text"))
            after = batch.column("after").to_numpy()
            cols = []
            for mod, base in moduli:
                got = [fingerprint(data[a:b], base, mod, table) * pow(base, int(n), mod) % mod for a, b, n in zip(offs[:-1], offs[1:], after)]
                cols.append(pa.array(got, pa.int64()))
            own = ["id", "row", "xx", "sha"] + ["text"] * with_text
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(np.diff(offs)), *cols], names=[*own, *KEYS])

    return run


def _cut(size: int, own: list[str]):
    """Pieces of ``size`` bytes of each text, as rows: the columns ``own``, k, part,
    after (bytes that follow); a text is held once, and few pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                data = text.as_buffer()
                starts = list(range(0, max(1, len(data)), size))
                for i in range(0, len(starts), 64):
                    some = starts[i : i + 64]
                    parts = [data.slice(a, min(size, len(data) - a)).to_pybytes() for a in some]
                    take = pa.array([row] * len(some))
                    cols = [*(batch.column(c).take(take) for c in own), pa.array(range(i, i + len(some)), pa.int64()), pa.array(parts, pa.binary()), pa.array([len(data) - a - len(p) for a, p in zip(some, parts)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*own, "k", "part", "after"])

    return run


def _hash_parts(moduli):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            parts, after = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("part")], batch.column("after").to_numpy()
            cols = [pa.array([fingerprint(x, base, mod, table) * pow(base, int(n), mod) % mod for x, n in zip(parts, after)], pa.int64()) for mod, base in moduli]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(x) for x in parts], pa.int64()), *cols], names=["row", *KEYS])

    return run


def fingerprints(src: DataFrame, moduli=MODULI, huge: int = HUGE, with_text: bool = False) -> DataFrame:
    """id, fingerprint columns, a 64-bit hash and the SHA-256 (binary) of each row
    of ``src`` (id, text), and on demand its text.

    Texts over ``huge`` bytes are cut in chunks that are hashed in separate tasks;
    a chunk's value is shifted by the bytes after it, and chunks are summed.
    """
    kind = src.schema["id"].dataType.simpleString()
    fixed = f"id {kind}, row string, xx long, sha binary" + ", text string" * with_text
    hashed = src.select("id", F.uuid().alias("row"), F.xxhash64("text").alias("xx"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    small = hashed.filter(F.octet_length("text") <= huge).withColumn("after", F.lit(0).cast("long"))
    out = small.mapInArrow(common.lean(_hash(moduli, with_text)), f"{fixed}, fp_bytes long, fp_1 long, fp_2 long").drop("row")
    big = common.saved(hashed.filter(F.octet_length("text") > huge), "huge")  # fixes the row names
    cut = big.select("row", "text").mapInArrow(_cut(huge, ["row"]), "row string, k long, part binary, after long")
    got = cut.repartition(F.col("row"), F.col("k")).mapInArrow(common.lean(_hash_parts(moduli)), "row string, fp_bytes long, fp_1 long, fp_2 long")
    sums = [(F.sum(f"fp_{i + 1}") % mod).alias(f"fp_{i + 1}") for i, (mod, _) in enumerate(moduli)]
    got = got.groupBy("row").agg(F.sum("fp_bytes").alias("fp_bytes"), *sums)
    return out.unionByName(big.join(got, "row").select(*out.columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli=MODULI, huge: int = HUGE) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; of equal texts the
    largest id stays (a null id only where no other is there; of rows that
    repeat that id one). Texts of any length are read whole. Other columns are ignored; an empty table gives an
    empty result.
    """
    out = _verdict(docs, id_col, text_col, moduli, huge)
    return out.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli=MODULI, huge: int = HUGE) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps: one of each text. Of rows
    that repeat id and text one stays; null counts as the empty text; an empty
    table stays so.
    """
    out = _verdict(docs, id_col, text_col, moduli, huge)
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("xx").cast("string"))
    return common.kept_rows(docs, out.select(key.alias("key"), "kept"), id_col, text_col)


def _verdict(docs: DataFrame, id_col: str, text_col: str, moduli, huge: int) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = common.saved(fingerprints(src, moduli, huge).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    out = _classes(rows, KEYS)
    members = out.filter("group_size > 1")
    differ = common.saved(_differing(src, members, moduli, huge), "differ")
    if not differ.isEmpty():
        # Different texts share a fingerprint: their classes go by whole content.
        rest = out.join(differ, KEYS, "left_anti")
        apart = out.join(differ, KEYS, "left_semi").drop("keep", "group_size")
        out = rest.unionByName(_classes(common.saved(apart, "apart"), [*KEYS, "sha"]))
    return out.withColumn("kept", F.col("row") == F.col("keep.row"))


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    groups = rows.groupBy(*keys).agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return common.saved(common.join_groups(rows, common.saved(groups, "groups"), keys, "group_size"), "classes")


def _differing(src: DataFrame, members: DataFrame, moduli, huge: int) -> DataFrame:
    """Fingerprints under which texts of different content lie.

    Only texts whose hash is in a filter of the members are read again. Chunks of a class stream through a least and a greatest value at each
    place; both combine before the shuffle, so copies aren't gathered.
    """
    words = common.repeat_filter(members, F.col("xx"), 1)
    again = common.flagged(src.withColumn("xx", F.xxhash64("text")), words, F.col("xx"), "member").filter("member").select("id", "text")
    rows = fingerprints(again, moduli, huge, with_text=True)
    parts = rows.select(*KEYS, "text").mapInArrow(common.lean(_cut(COMPARED, KEYS)), "fp_bytes long, fp_1 long, fp_2 long, k long, part binary, after long")
    ends = parts.groupBy(*KEYS, "k").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    return ends.filter("least <> most").select(*KEYS).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_exact_dedup over the whole of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
