"""Unions of object tables, tuple groups, spectral compensation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .populations import named
from .store import saved


def merge_by_name(tables: Mapping[str, DataFrame], file_col: str = "import_file") -> DataFrame:
    """Rows of all tables with their origin; columns that a table lacks are null.
    Columns that all share come last."""
    frames = [df.withColumn(file_col, F.lit(name)) for name, df in tables.items()]
    if not frames:
        raise ValueError("nothing to merge")
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    own = list(dict.fromkeys(c for f in frames for c in f.columns if c not in shared))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*(named(c) for c in [*own, *(c for c in shared if c != file_col), file_col]))


def merge_by_position(tables: Mapping[str, DataFrame], file_col: str = "import_file") -> DataFrame:
    """Rows of all tables joined column by column; of two names for a place the
    longer one stays. All tables need as many columns."""
    frames = list(tables.values())
    if len({len(f.columns) for f in frames}) != 1:
        raise ValueError("tables need equally many columns")
    names = [max(cs, key=len) for cs in zip(*(f.columns for f in frames))]
    if len(set(names)) < len(names):
        raise ValueError(f"the longer names repeat: {names}")
    return reduce(lambda a, b: a.union(b), (f.toDF(*names).withColumn(file_col, F.lit(n)) for n, f in tables.items()))


def bind_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_2") -> DataFrame:
    """Columns of both tables for the same object; clashing names get ``suffix``."""
    names = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(names), list(keys), "left")


def factor_codes(df: DataFrame, column: str, name: str = "code", nulls: bool = True) -> DataFrame:
    """``df`` with the 1-based place of each value among the sorted distinct ones;
    nulls come last (or get no code).

    The distinct values are ranked by counts of ranges, then joined back: the
    table itself is neither sorted nor put in one task.
    """
    kinds = df.select(named(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    ranked = ranks(kinds, "_v", name)
    out = df.join(ranked, named(column) == F.col("_v"), "left").drop("_v")
    last = ranked.agg(F.count("*").alias("_n"))  # one row
    if not nulls:
        return out
    out = out.join(F.broadcast(last))
    return out.withColumn(name, F.when(named(column).isNull(), F.col("_n") + 1).otherwise(F.col(name))).drop("_n")


def ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """1-based rank of distinct values, by ranges: each is numbered by itself and
    starts after the sizes of those before it (one number per range)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled, so the dealt rows are written once and read from there.
    dealt = saved(rows.repartitionByRange(n, column).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))  # a row per range
    return inside.join(F.broadcast(sizes), "_part").select(column, (F.col("_in") + F.col("_ahead")).cast("long").alias(name))


def tuple_groups(df: DataFrame, columns: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Each distinct tuple with its number of rows; tuples with a null are left out
    unless ``keep_null``."""
    known = df if keep_null else df.dropna(subset=list(columns))
    return known.groupBy(*map(named, columns)).agg(F.count("*").alias("n"))


def parse_spillover(text: str) -> dict[str, dict[str, float]]:
    """Rows of the matrix in a ``n,names...,values...`` keyword."""
    n, *rest = [x.strip() for x in text.split(",")]
    size = int(n)
    names, values = rest[:size], list(map(float, rest[size:]))
    if len(values) != size * size or len(set(names)) < size:
        raise ValueError(f"spillover: {size} names and {size * size} values are needed")
    return {a: dict(zip(names, values[i * size : (i + 1) * size])) for i, a in enumerate(names)}


def format_spillover(matrix: Mapping[str, Mapping[str, float]]) -> str:
    names = list(matrix)
    return ",".join([str(len(names)), *names, *(repr(float(matrix[a][b])) for a in names for b in names)])


def compensate(df: DataFrame, spillover: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``df`` with the spillover between its columns taken out: the observed row is
    the true row times the matrix, whose rows and columns are matched by name."""
    names = list(spillover)
    inverse = np.linalg.inv(np.array([[float(spillover[a][b]) for b in names] for a in names]))
    new = {b: reduce(lambda s, t: s + t, (named(a).cast("double") * float(inverse[i, j]) for i, a in enumerate(names))) for j, b in enumerate(names)}
    return df.withColumns(new)


def pick(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose ``column`` is one of ``values``."""
    return df.filter(named(column).isin(*values))
