"""Operator 5: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams (1 to 3 code points), trained with follow-the-regularised-leader under
an elastic net, then calibrated by a temperature on rows kept apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ftrl import Ftrl, shard_means

BITS = 16
SIZES = (1, 2, 3)
LETTER = re.compile(r"[^\W\d_]")
#: The values are scaled so that typical ones are near 1.
SCALE = 10.0
#: Code points that numpy handles at once.
AT_ONCE = 1 << 19


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and row of every n-gram of the lower-cased ``texts``; two pads
    follow each text, and n-grams that start on a pad are left out."""
    joined = "".join(t + "\0\0" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lens)
    start = np.arange(len(row)) + 2 * row
    key, out = np.zeros(len(row), np.uint64), []
    for k in SIZES:
        key = (key + cp[start + (k - 1)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.stack(out), row


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled at once."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _lowered(col: pa.Array) -> list[str]:
    return [(x or "").lower() for x in col.to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts with each bucket; bucket -1 counts all texts of the task."""
    seen, df, n = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        texts = _lowered(batch.column("text"))
        n += len(texts)
        for i, j in groups_of(texts):
            bucket, row = grams(texts[i:j])
            ends = np.searchsorted(row, np.arange(j - i + 1))
            for a, b in zip(ends[:-1], ends[1:]):
                seen[bucket[:, a:b]] = True
                hit = np.flatnonzero(seen)
                df[hit] += 1
                seen[hit] = False
    hit = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(df[hit], n), pa.int64())], names=["bucket", "df"])


def _features(idf: np.ndarray):
    """id columns with the buckets and TF-IDF values of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for t in _lowered(batch.column("text")):
                bucket, _ = grams([t])
                u, c = np.unique(bucket, return_counts=True)
                at.append(u)
                x.append(c * idf[u] * (SCALE / max(1, len(t))))
            cols = [batch.column(c) for c in ("lang", "shard", "order")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], names=["lang", "shard", "order", "at", "x"])

    return run


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    #: idf times weight of each bucket and language, and the bias.
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for i, j in groups_of(texts):
            bucket, row = grams(texts[i:j])
            for k in range(len(SIZES)):
                for lang in range(len(self.langs)):
                    out[i:j, lang] += np.bincount(row, self.table[lang].take(bucket[k]), j - i)
        n = np.array([max(1, len(t)) for t in texts])
        return out * (SCALE / n)[:, None] + self.bias


def _predict(model: Model, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(batch.column("text"))
            s = model.logits(texts)
            if raw:
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(s), pa.list_(pa.float64()))], names=["lang", "logits"])
                continue
            known = np.array([bool(LETTER.search(t)) for t in texts], bool)
            p = softmax(s / model.temperature) if model.langs else np.zeros((len(texts), 0))
            best = p.argmax(axis=1) if model.langs else np.zeros(len(texts), int)
            known &= bool(model.langs)
            names = [model.langs[b] if k else "und" for b, k in zip(best, known)]
            score = [float(p[r, b]) if known[r] else 0.0 for r, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def fit(rows: DataFrame, sample: int = 12_000, shards: int = 4, epochs: int = 3, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Model from ``rows`` (id, text, lang; no nulls in text and lang).

    Document frequencies and languages come from all rows; the weights and the
    temperature from at most ``sample`` ids, a fifth of them for the latter; of
    rows that repeat an id one is learnt from.
    """
    counts = {r["bucket"]: r["df"] for r in rows.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    n = max(1, counts.pop(-1, 0))
    df = np.zeros(1 << BITS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + n) / (1 + df)) + 0.1
    if not langs:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    order = F.xxhash64(F.col("id").cast("string"), F.lit("language"))
    # At most ``sample`` ids, the first of a hashed order.
    picked = rows.select("id", order.alias("order")).orderBy("order", "id").limit(sample).distinct()
    chosen = rows.join(F.broadcast(common.saved(picked, "sample")), "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("text", "lang", "order")))
    chosen = chosen.withColumn("part", F.pmod(F.col("order"), F.lit(5)))
    chosen = common.saved(chosen, "chosen")
    train = chosen.filter("part <> 0").withColumn("shard", F.pmod(F.shiftright("order", 8), F.lit(shards)).cast("int")).repartition(4 * shards)
    feats = train.select("lang", "shard", "order", "text").mapInArrow(_features(idf), "lang string, shard int, order long, at array<int>, x array<double>")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model, index = Ftrl((1 << BITS) + 1, len(langs), alpha, l1, l2), {x: i for i, x in enumerate(langs)}
        ats = [np.append(a, 1 << BITS).astype(np.int64) for a in pdf["at"]]
        xs = [np.append(x, 1.0)[:, None] for x in pdf["x"]]
        ys = [index[x] for x in pdf["lang"]]
        for _ in range(epochs):
            for at, x, y in zip(ats, xs, ys):
                w = model.weights(at)
                p = softmax((w * x).sum(axis=0))
                p[y] -= 1.0
                model.update(at, w, x * p)
        w = model.weights(slice(None))
        at, lang = np.nonzero(w)
        return pd.DataFrame({"bucket": at.astype(np.int32), "lang": lang.astype(np.int32), "w": w[at, lang]})

    # At most 2 ** BITS + 1 buckets times the languages.
    weights = shard_means(feats, learn, shards, "bucket int, lang int, w double", ["bucket", "lang"]).collect()
    table, bias = np.zeros((len(langs), 1 << BITS)), np.zeros(len(langs))
    for r in weights:
        if r["bucket"] == 1 << BITS:
            bias[r["lang"]] = r["w"]
        else:
            table[r["lang"], r["bucket"]] = r["w"] * idf[r["bucket"]]
    model = Model(langs, table, bias, 1.0)
    apart = chosen.filter("part = 0").select("lang", "text").mapInArrow(_predict(model, True), "lang string, logits array<double>").collect()
    if apart:
        s, y = np.array([r["logits"] for r in apart]), np.array([langs.index(r["lang"]) for r in apart])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(s / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (0 to 1).

    The model learns from rows where ``held_out`` is false and text and language
    are given; predictions see the text alone. Null texts, and texts without a
    letter, are "und" with score 0, as are all if nothing can be learned. Of
    languages that are equally likely the first by name is taken. Repeated
    rows repeat (and weigh) as such; null ids pass through; texts of any length are
    read whole; other columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(src.filter("not held_out and text is not null and lang is not null").select("id", "text", "lang"), **settings)
    kind = src.schema["id"].dataType.simpleString()
    out = src.select("id", "text", "held_out").mapInArrow(_predict(model, False), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_language_id over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
