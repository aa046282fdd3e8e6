"""Operator 9: ordinal quality classifier.

Cumulative-link logistic regression: one weight vector over hashed words,
word beginnings and character shares, shared by all grades, and ordered thresholds between them.
Gives the expected grade and the probability of reaching the grade asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ftrl import Ftrl, shard_means

BITS = 18
#: Bytes of the beginnings of longer words that are features as well.
BEGINNINGS = (4, 5, 6, 7)
#: Classes of bytes whose shares are features: each ASCII mark, digits, capitals.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS = np.zeros(256, np.uint8)
CLASS[MARKS] = np.arange(1, len(MARKS) + 1)
CLASS[48:58] = len(MARKS) + 1
CLASS[65:91] = len(MARKS) + 2
N_CLASSES = len(MARKS) + 3
#: Features: word buckets, then class shares.
SIZE = (1 << BITS) + N_CLASSES
#: Bytes of a word: letters, digits and all beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
AS_WORD = np.where(IS_WORD, common.LOWER, np.uint8(0x20)).astype(np.uint8)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct word (lower case, without marks) and word
    beginning of each text."""
    lo, hi = int(offs[0]), int(offs[-1])
    buf = AS_WORD[data[lo:hi]]
    starts, ends, row = common.words_of(buf, offs - lo)
    keys = [(row.astype(np.int64) << BITS) | _bucket(common.word_hashes(buf, starts, ends))]
    for k in BEGINNINGS:
        more = ends - starts > k
        h = common.word_hashes(buf, starts[more], starts[more] + k) + np.uint64(k)
        keys.append((row[more].astype(np.int64) << BITS) | _bucket(common.mix64(h)))
    both = np.unique(np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


def class_shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Thirty times the share of each byte class, 3 at most, for each text."""
    lo, hi = int(offs[0]), int(offs[-1])
    lens = np.diff(offs)
    row = np.repeat(np.arange(len(lens)), lens)
    n = np.bincount(row * N_CLASSES + CLASS[data[lo:hi]], minlength=len(lens) * N_CLASSES).reshape(-1, N_CLASSES)
    n[:, 0] = 0
    return np.minimum(3.0, 30.0 * n / np.maximum(lens, 1)[:, None])


@dataclass
class Model:
    weights: np.ndarray
    #: Thresholds between grades, ascending; the grades they part.
    thresholds: np.ndarray
    grades: list[int]

    def scores(self, col: pa.Array) -> np.ndarray:
        data, offs = common.utf8(col)
        out = np.zeros(len(offs) - 1)
        for i, j in common.chunks(offs):
            part = offs[i : j + 1]
            row, bucket = word_features(data, part)
            out[i:j] = np.bincount(row, self.weights[bucket], j - i) + class_shares(data, part) @ self.weights[1 << BITS :]
        return out

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = common.utf8(batch.column("text"))
        for i, j in common.chunks(offs):
            at, x, part = [], [], offs[i : j + 1]
            row, bucket = word_features(data, part)
            shares, ends = class_shares(data, part), np.searchsorted(row, np.arange(j - i + 1))
            for r in range(j - i):
                more = np.flatnonzero(shares[r])
                at.append(np.concatenate([bucket[ends[r] : ends[r + 1]], more + (1 << BITS)]))
                x.append(np.concatenate([np.ones(ends[r + 1] - ends[r]), shares[r][more]]).astype(np.float32))
            cols = [batch.column(c).slice(i, j - i) for c in ("grade", "shard", "order")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["grade", "shard", "order", "at", "x"])


def _start(share: np.ndarray) -> np.ndarray:
    """Thresholds that give grades their shares at score 0."""
    above = np.clip(share[::-1].cumsum()[::-1][1:], 1e-3, 1 - 1e-3)
    t = np.log((1 - above) / above)
    return np.maximum.accumulate(t + 1e-6 * np.arange(len(t)))


def fit(docs: DataFrame, marks: DataFrame, sample: int = 12_000, shards: int = 1, epochs: int = 4, alpha: float = 0.3, l1: float = 4.5, l2: float = 0.1) -> Model:
    """Model from ``docs`` (id, text) and ``marks`` (id, grade; an id once), of which
    at most ``sample`` ids are taken, the first of a hashed order; of rows that
    repeat an id one is learnt from.

    Ids are chosen before any text is read; then the few chosen meet their texts
    where these lie. One task holds ``sample`` / ``shards`` of them; averaging
    more shards lets more toxic texts pass, as each sees fewer of their words.
    """
    order = F.xxhash64(F.col("id").cast("string"), F.lit("quality"))
    known = marks.join(docs.select("id"), "id", "left_semi").select("id", "grade", order.alias("order"))
    picked = common.saved(known.orderBy("order", "id").limit(sample), "sample")
    chosen = docs.join(F.broadcast(picked), "id").groupBy("id").agg(*(F.first(c).alias(c) for c in ("text", "grade", "order")))
    chosen = chosen.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")).repartition(4 * shards)
    feats = common.saved(chosen.select(F.col("grade").cast("int").alias("grade"), "shard", "order", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(common.lean(_features), "grade int, shard int, order long, at array<int>, x array<float>"), "features")
    seen = {r["grade"]: r["count"] for r in feats.groupBy("grade").count().collect()}
    grades = sorted(seen)
    if len(grades) < 2:
        return Model(np.zeros(SIZE), np.zeros(0), grades)
    n = np.array([seen[g] for g in grades], float)
    first, index = _start(n / n.sum()), {g: i for i, g in enumerate(grades)}
    top = len(grades) - 1

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model, t = Ftrl(SIZE, 1, alpha, l1, l2), first.copy()
        ats, xs, ys = list(pdf["at"]), list(pdf["x"]), [index[g] for g in pdf["grade"]]
        for epoch in range(epochs):
            rate = 0.05 / (1 + epoch)
            for at, x, y in zip(ats, xs, ys):
                w = model.weights(at)
                s = float(w[:, 0] @ x)
                p = 1 / (1 + np.exp(np.clip(t - s, -30, 30)))  # P(grade >= k)
                over, under = (p[y - 1] if y else 1.0), (p[y] if y < top else 0.0)
                d = (over * (1 - over) - under * (1 - under)) / max(over - under, 1e-9)  # of ln P(y) by s
                if y:
                    t[y - 1] -= rate * over * (1 - over) / max(over - under, 1e-9)
                if y < top:
                    t[y] += rate * under * (1 - under) / max(over - under, 1e-9)
                np.maximum.accumulate(t, out=t)
                model.update(at, w, (-d * x)[:, None])
        w = model.weights(slice(None))[:, 0]
        at = np.flatnonzero(w)
        # Thresholds follow the weights, at negative places.
        return pd.DataFrame({"at": np.concatenate([at, -1 - np.arange(top)]).astype(np.int32), "w": np.concatenate([w[at], t])})

    weights, t = np.zeros(SIZE), np.zeros(top)
    for r in shard_means(feats, learn, shards, "at int, w double", ["at"]).collect():  # at most SIZE + top rows
        if r["at"] < 0:
            t[-1 - r["at"]] = r["w"]
        else:
            weights[r["at"]] = r["w"]
    return Model(weights, np.maximum.accumulate(t), grades)


def judged(model: Model, col: pa.Array, grade: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of ``grade`` or better, of each text."""
    p, grades = model.at_least(model.scores(col)), model.grades or [grade]
    expected = grades[0] + p @ np.diff(grades) if p.shape[1] else np.full(len(p), float(grades[0]))
    if grades[0] >= grade:
        return expected, np.ones(len(p))
    above = [k for k, g in enumerate(grades[1:]) if g >= grade]
    return expected, p[:, above[0]] if above else np.zeros(len(p))


def _predict(model: Model, grade: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = judged(model, batch.column("text"), grade)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["id", "expected_grade", "p_tail"])

    return run


def _learnt(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, rating_id: str, settings: dict) -> Model:
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = ratings.filter(F.col(rating_id).isNotNull() & F.col("grade").isNotNull()).groupBy(F.col(rating_id).alias("id")).agg(F.min("grade").alias("grade"))
    return fit(src, marks, **settings)


def quality_classifier(docs: DataFrame, ratings: DataFrame, grade: int = 2, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", rating_id: str = "doc_id", **settings) -> DataFrame:
    """One row per row of ``docs``: id, expected_grade, p_tail (probability of
    ``grade`` or better), kept (p_tail >= ``least``).

    ``ratings``: id, grade (int, higher is better); of several ratings of an id
    the worst counts; rows without id or grade, or of unknown ids, are not used.
    Null texts count as empty and are judged by the thresholds alone. Without
    two grades to learn from, all is kept or, under a single lower grade, none.
    Null and repeated ids pass through; equal texts are judged alike; texts of any
    length are read whole; other columns are ignored; an empty table gives no rows.
    """
    model = _learnt(docs, ratings, id_col, text_col, rating_id, settings)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(common.lean(_predict(model, grade)), f"id {kind}, expected_grade double, p_tail double")
    return out.select(F.col("id").alias(id_col), "expected_grade", "p_tail", (F.col("p_tail") >= least).alias("kept"))


def good_rows(docs: DataFrame, ratings: DataFrame, grade: int = 2, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", rating_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, whole, that ``quality_classifier`` keeps; they are judged
    and passed on where they lie, repeated and null ones as such."""
    model = _learnt(docs, ratings, id_col, text_col, rating_id, settings)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tail = judged(model, batch.column("text"), grade)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(tail >= least))], names=["row"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(common.lean(run), f"row {kind}").select("row.*")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of ``labels``: 0 toxic, 1 of low quality, 2 good."""
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_quality_classifier over the whole of ``documents``, learnt from ``labels``."""
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
