"""Operator 8: token counts with a digest cache.

A text's content digest and the tokenizer file's digest name a count. Counts of
known digests come from the cache (a Parquet folder); of the others each
distinct content is encoded once and appended to it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points for which both tokenizer libraries agree on letters, digits and
#: spaces: the Latin, Greek and Cyrillic blocks, common punctuation, kana, CJK.
PLAIN = re.compile("[\x00-ɏΆ-ϿЀ-ҁ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]*")
CACHE = "digest binary, version string, n_tokens long"


@functools.cache
def version(file: str) -> str:
    """Digest of a tokenizer file."""
    with open(file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@common.kept
def counter(file: str, ranks: str | None):
    """A function from text to its number of tokens under ``file``.

    ``ranks``: the same vocabulary as ranks, which encodes several times faster;
    texts outside PLAIN go through ``file`` itself, so counts never differ.
    """
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(file)
    slow.no_padding()
    slow.no_truncation()
    if ranks is None:
        return lambda text: len(slow.encode(text, add_special_tokens=False).ids)
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(file, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def count(text: str) -> int:
        if PLAIN.fullmatch(text) and not any(s in text for s in special):
            return len(fast.encode_to_numpy(text, disallowed_special=()))
        return len(slow.encode(text, add_special_tokens=False).ids)

    return count


def _encode(file: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file, ranks)
        for batch in batches:
            n = [count(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, file: str, ranks: str | None = None, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, and whether
    the count was in the cache before (from_cache).

    ``cache`` is a Parquet folder, new or filled by earlier calls under any
    tokenizer; without one, counts live for this call only. Null texts count as
    empty (0 tokens); null and repeated ids pass through, row for row; equal
    texts share one encoding; texts of any length are encoded whole; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    v = version(file)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = common.saved(src.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keyed")
    groups = keyed.groupBy("digest").agg(F.count("*").alias("copies"))
    cache = cache or common.new_path(spark, "token-cache")
    known = _read(spark, cache).filter(F.col("version") == v).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = common.saved(groups.join(known, "digest", "left_anti"), "misses")
    # Texts whose bucket holds one missing row are encoded in place; only
    # possible repeats are shuffled, to one text per digest.
    key = F.xxhash64("digest")
    miss = common.flagged(src, common.repeat_filter(misses, key, 1), key, "miss").filter("miss")
    often = common.flagged(miss, common.repeat_filter(keyed, key, 2), key, "often")
    once = often.filter("not often").select("digest", "text")
    many = often.filter("often").groupBy("digest").agg(F.first("text").alias("text")).join(misses.select("digest"), "digest", "left_semi")
    encoded = once.unionByName(many).mapInArrow(_encode(file, ranks), "digest binary, n_tokens long")
    encoded.select("digest", F.lit(v).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = _read(spark, cache).filter(F.col("version") == v).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh = misses.select("digest", F.lit(True).alias("fresh"))
    table = groups.join(counts, "digest").join(fresh, "digest", "left").select("digest", "copies", "n_tokens", F.col("fresh").isNull().alias("from_cache"))
    out = common.join_groups(keyed, common.saved(table, "counts"), ["digest"], "copies")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "from_cache")


def _read(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where the folder isn't there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_token_counts over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
