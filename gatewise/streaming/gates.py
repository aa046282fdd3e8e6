"""Gates on streams: populations are row-wise, so a stream of objects is gated by
the same catalog, and counted per window of event time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.populations import Objects, member


def gated(stream: DataFrame, objects: Objects, pops: list[str]) -> DataFrame:
    """The stream with a membership column per population. Tagged tables of ids
    join as static tables."""
    return replace(objects, df=stream).members(pops)


def windowed_counts(stream: DataFrame, objects: Objects, pops: list[str], time: str, width: str, late: str) -> DataFrame:
    """start, total and n_<population> of each window; rows later than ``late``
    behind the newest are dropped, and closed windows leave the state."""
    rows = gated(stream, objects, pops).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = [F.count_if(member(p)).alias(f"n_{p}") for p in pops]
    return rows.groupBy(F.window(time, width)).agg(F.count("*").alias("total"), *counts).select(F.col("window.start").alias("start"), "total", *(f"n_{p}" for p in pops))
