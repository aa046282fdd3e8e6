"""Operator 13: harmonic packing.

Class k holds the pieces of more than ``capacity / (k + 1)`` and at most
``capacity / k`` tokens, and k of them fill a sequence. A document's tokens are cut
so that each piece comes close to the upper end of its class, so sequences of a fixed
number of pieces waste little. Rows of a class are dealt to ranges, sized by the
class's number of pieces, and every range fills its sequences alone. What is left over in
the ranges (under one sequence each) is packed by best fit.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, packing

CAPACITY = 4096
#: A piece stays whole if it leaves at most this share of its place empty.
SLACK = 1 / 96
#: Sequences that a range fills at least, where its class has so many.
SEQUENCES = 256
#: Sequence numbers: those of what is left over begin here, a range has 2 ** RANGE_BITS.
LEFT_OVER, RANGE_BITS = 1 << 62, 28


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order: whole sequences, then by
    turns the longest reciprocal share of ``capacity`` that fits, until the rest
    is itself close to such a share."""
    return [capacity] * (n // capacity) + _shares(n % capacity, capacity, slack)


@functools.cache
def _shares(n: int, capacity: int, slack: float) -> list[int]:
    out = []
    while n:
        k = capacity // n
        if k * n >= capacity * (1 - slack) or capacity // (k + 1) == 0 or (capacity // k) == n:
            return [*out, n]
        share = capacity // (k + 1)
        out.append(share)
        n -= share
    return out


def _pieces(file: str, capacity: int, slack: float, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = packing.encoder(file), np.array([end_id], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, start, length, crc, whole, ids = [], [], [], [], [], []
            for row, found in enumerate(packing.encoded(encode, batch.column("text"))):
                data, at = found + end, 0
                for n in cuts(len(data) // 4, capacity, slack):
                    part = data[4 * at : 4 * (at + n)]
                    rows.append(row)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    whole.append(len(data) // 4)
                    if with_ids:
                        ids.append(part)
                    at += n
            numbers = (start, length, crc, whole, [place + i for i in range(len(rows))])
            place += len(rows)
            cols = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "place"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, place (a number for each row) and
    ids, if wanted, of the pieces of each text and its end id."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long" + ", ids binary" * with_ids
    return src.mapInArrow(common.lean(_pieces(file, capacity, slack, end_id, with_ids), packing.encoder), schema)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (id, start, length, ids_crc32, place, ...; a saved table) with sequence_id
    and offset. A class's rows are shuffled once, to their ranges."""
    spark = parts.sparkSession
    parts = parts.withColumn("class", F.floor(F.lit(capacity) / F.col("length")))
    # At most 2 * sqrt(capacity) classes.
    counts = {r["class"]: r["n"] for r in parts.groupBy("class").agg(F.count("*").alias("n")).collect()}
    first, rows = 0, []
    for k, n in sorted(counts.items()):
        ranges = max(1, n // (k * SEQUENCES))
        rows.append((k, first, ranges))
        first += ranges
    table = F.broadcast(spark.createDataFrame(rows, "class long, _first long, _ranges long"))
    dealt = parts.join(table, "class").withColumn("range", F.col("_first") + F.pmod(F.xxhash64("place"), F.col("_ranges"))).drop("_first", "_ranges")
    in_range = Window.partitionBy("class", "range")
    dealt = dealt.withColumn("_rank", F.row_number().over(in_range.orderBy("place")).cast("long") - 1)
    dealt = dealt.withColumn("_n", F.count("*").over(in_range)).withColumn("_at", F.floor(F.col("_rank") / F.col("class")))
    before = Window.partitionBy("class", "range", "_at").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    dealt = dealt.withColumn("sequence_id", F.when((F.col("_at") + 1) * F.col("class") <= F.col("_n"), F.shiftleft("range", RANGE_BITS) + F.col("_at")))
    dealt = common.saved(dealt.drop("_rank", "_n", "_at", "class", "range"), "dealt")
    full = dealt.filter("sequence_id is not null")
    rest = dealt.filter("sequence_id is null").drop("sequence_id", "offset").withColumn("piece", F.col("place"))
    rest = packing.pack(rest, capacity).withColumn("sequence_id", F.col("sequence_id") + F.lit(LEFT_OVER))
    return full.unionByName(rest.drop("piece"))


def harmonic_packing(docs: DataFrame, file: str, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (ids), sequence_id,
    offset. A document's pieces cover its tokens and the end id, each once; a
    sequence holds ``capacity`` tokens at most, from offset 0 on without gaps.

    Null texts are empty: one piece with the end id. Repeated rows are packed each;
    null ids pass through; texts of any length are whole; other columns are
    ignored; an empty table gives no rows.
    """
    parts = common.saved(pieces(docs, file, capacity, slack, end_id, with_ids, id_col, text_col), "pieces")
    names = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids + ["sequence_id", "offset"]
    return pack(parts, capacity).select(F.col("id").alias(id_col), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_harmonic_packing over the whole of ``documents``."""
    import public_tokenizers

    return harmonic_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
