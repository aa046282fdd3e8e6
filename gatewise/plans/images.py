"""Queries of image arrays; embeddings stand in for pixels (8 columns)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import images as kernels
from .common import query, table

WIDTH = 8


def _images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("pixels"), F.lit(WIDTH).alias("width"), (F.size("embedding") / WIDTH).cast("int").alias("height"))


def _height(spark, sf_dir) -> int:
    return _images(spark, sf_dir).select("height").first()["height"]


def _round(pixels):
    """Rounded, with 0 in place of -0."""
    return F.transform(pixels, lambda v: F.round(v, 6) + F.lit(0.0))


def _round_sql(v: str) -> str:
    return f"CASE WHEN round({v}, 6) = 0 THEN 0.0::DOUBLE ELSE round({v}, 6) END"


_DOUBLES = "list_transform(embedding, lambda v: v::DOUBLE)"


@query(f"SELECT vec_id, list_transform({_DOUBLES}, lambda v: {_round_sql("(CASE WHEN v <= -0.1 THEN 0.0 WHEN v >= 0.15 THEN 1.0 ELSE pow((v + 0.1) / 0.25, 0.5) END)")}) AS pixels FROM embeddings")
def img_normalize(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", _round(arrays.normalized(F.col("pixels"), -0.1, 0.15, 0.5)).alias("pixels"))


@query(f"SELECT vec_id, list_transform(p, lambda v: {_round_sql("((v - list_min(p)) / (list_max(p) - list_min(p)))")}) AS pixels FROM (SELECT vec_id, {_DOUBLES} AS p FROM embeddings)")
def img_force_range(spark, sf_dir):
    return _images(spark, sf_dir).select("vec_id", _round(arrays.force_range(F.col("pixels"))).alias("pixels"))


@query(f"SELECT vec_id, flatten(list_transform(range((len(p) // 8 - 4) // 2, (len(p) // 8 - 4) // 2 + 4), lambda r: p[r * 8 + 3 : r * 8 + 6])) AS pixels FROM (SELECT vec_id, {_DOUBLES} AS p FROM embeddings)")
def img_crop(spark, sf_dir):
    """The central 4 x 4 pixels."""
    h = _height(spark, sf_dir)
    return _images(spark, sf_dir).select("vec_id", arrays.cropped(F.col("pixels"), h, WIDTH, 4, 4).alias("pixels"))


@query(f"SELECT vec_id, flatten(list_transform(range(0, len(p) // 8), lambda r: [7.0::DOUBLE] || p[r * 8 + 1 : r * 8 + 8] || [7.0::DOUBLE, 7.0::DOUBLE])) AS pixels FROM (SELECT vec_id, {_DOUBLES} AS p FROM embeddings)")
def img_pad(spark, sf_dir):
    """Three more columns of background; the odd one is on the right."""
    h = _height(spark, sf_dir)
    return _images(spark, sf_dir).select("vec_id", arrays.padded(F.col("pixels"), h, WIDTH, h, WIDTH + 3, 7.0).alias("pixels"))


@query(f"SELECT vec_id, list_transform({_DOUBLES}, lambda v: CASE WHEN v > 0.1 OR v < -0.1 THEN -1.0 ELSE v END) AS pixels, len(list_filter(embedding, lambda v: v::DOUBLE > 0.1 AND NOT v::DOUBLE < -0.1)) AS n FROM embeddings")
def img_mask(spark, sf_dir):
    """Masks joined by Or, And and Not; masked pixels become background."""
    rows = _images(spark, sf_dir).select("vec_id", "pixels", F.transform("pixels", lambda v: v > 0.1).alias("hi"), F.transform("pixels", lambda v: v < -0.1).alias("lo"))
    mask = F.transform(arrays.either(F.col("hi"), F.col("lo")), lambda b: b.cast("int"))
    both = arrays.both(F.col("hi"), arrays.negated(F.col("lo")))
    return rows.select("vec_id", arrays.cleansed(F.col("pixels"), mask, -1.0).alias("pixels"), F.size(F.filter(both, lambda b: b)).cast("long").alias("n"))


@query(f"SELECT vec_id, list_transform(p, lambda v, i: {_round_sql("(0.75 * v + 0.25 * p[len(p) + 1 - i])")}) AS pixels FROM (SELECT vec_id, {_DOUBLES} AS p FROM embeddings)")
def img_composite(spark, sf_dir):
    """A weighted sum of two channels (the second is the image backwards)."""
    p = F.col("pixels")
    return _images(spark, sf_dir).select("vec_id", _round(arrays.composite([(0.75, p), (0.25, F.reverse(p))])).alias("pixels"))


@query(f"SELECT vec_id, list_transform(p, lambda v, i: {_round_sql("(CASE WHEN i % 8 = 0 THEN 0.5 * v ELSE 0.5 * v + 0.5 * p[i + 1] END)")}) AS pixels FROM (SELECT vec_id, {_DOUBLES} AS p FROM embeddings)")
def img_align(spark, sf_dir):
    """Half a pixel to the left, bilinear; background 0 comes in."""
    out = kernels.image_map(_images(spark, sf_dir), lambda a: kernels.align(a, 0.5, 0.0), ["vec_id"])
    return out.select("vec_id", _round(F.col("pixels")).alias("pixels"))


@query("SELECT count(*) AS n, 0 AS n_off FROM embeddings")
def codec_roundtrip(spark, sf_dir):
    """Images that a codec does not bring back (runs and differences)."""
    rows = _images(spark, sf_dir).select("vec_id", "height", "width", F.transform("pixels", lambda v: F.round(v * 4000).cast("double")).alias("pixels"))

    def off(a: np.ndarray) -> np.ndarray:
        whole, mask = a.astype(int), (a > 0).astype(int) + (a > 200)
        same = np.array_equal(kernels.delta_decode(kernels.delta_encode(whole), *a.shape), whole) and np.array_equal(kernels.run_decode(kernels.run_encode(mask), *a.shape), mask)
        return np.array([[float(not same)]])

    return kernels.image_map(rows, off, ["vec_id"]).agg(F.count("*").alias("n"), F.sum(F.element_at("pixels", 1)).cast("int").alias("n_off"))


@query("SELECT vec_id, 54 + (len(embedding) // 8) * 24 AS n_bytes, 'BM' AS magic FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 50")
def gallery_topk(spark, sf_dir):
    """The first 50 images of a class as bitmaps, in order."""
    picked = _images(spark, sf_dir).join(table(spark, sf_dir, "embeddings").filter("label = 1").select("vec_id"), "vec_id").orderBy("vec_id").limit(50)
    unit = picked.withColumn("pixels", arrays.force_range(F.col("pixels")))
    data = F.col("data")
    return kernels.encoded(unit, "bmp", ["vec_id"]).select("vec_id", F.octet_length(data).cast("long").alias("n_bytes"), F.substring(data, 1, 2).cast("string").alias("magic"))
