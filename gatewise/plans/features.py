"""Queries of feature expressions and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transforms import transform
from ..operators.catalog import Feature
from .common import LINE_ID, lin_log_sql, lines, query

_KEY = f"{LINE_ID} AS object_number"


def _features(spark, sf_dir, *features: Feature):
    objects = lines(spark, sf_dir).add_features(*features)
    return objects.values().select("object_number", *(F.round(F.col(f"`{f.name}`"), 6).alias(f.name) for f in features))


@query(f"SELECT {_KEY}, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, round(l_extendedprice / l_quantity - l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity, 6) AS gap FROM lineitem")
def feat_combined(spark, sf_dir):
    """Combined features, one of which needs the other."""
    return _features(
        spark,
        sf_dir,
        Feature("charge", "combined", "l_extendedprice|*|(|1|-|l_discount|)|*|(|1|+|l_tax|)"),
        Feature("gap", "combined", "l_extendedprice|/|l_quantity|-|charge|/|l_quantity"),
    )


@query(f"SELECT {_KEY}, round(sqrt(abs(cos(l_quantity))) + pow(sin(l_discount), 2) - l_tax, 6) AS wave FROM lineitem")
def feat_unary(spark, sf_dir):
    """Functions take the next operand without parentheses."""
    return _features(spark, sf_dir, Feature("wave", "combined", "SQRT|ABS|COS|l_quantity|+|SQR|SIN|l_discount|-|l_tax"))


@query("SELECT count(*) FILTER (l_discount = 0) AS n_nan, count(*) FILTER (l_discount <> 0) AS n_finite, round(sum(l_tax / l_discount) FILTER (l_discount <> 0), 4) AS total FROM lineitem")
def feat_div_zero(spark, sf_dir):
    """Divisions by zero give NaN; the query counts and sums."""
    rows = lines(spark, sf_dir).add_features(Feature("ratio", "combined", "l_tax|/|l_discount")).values()
    ok = ~F.isnan("ratio")
    return rows.agg(F.count_if(~ok).alias("n_nan"), F.count_if(ok).alias("n_finite"), F.round(F.sum(F.when(ok, F.col("ratio"))), 4).alias("total"))


def _scaled(spark, sf_dir, spec: str, inverse: bool = False, x: str = "l_extendedprice"):
    df = lines(spark, sf_dir).df
    return df.select("object_number", F.round(transform(F.expr(x), spec, inverse), 6).alias("v"))


@query(f"SELECT {_KEY}, round({lin_log_sql('(l_extendedprice - 2000)', 1000.0)}, 6) AS v FROM lineitem")
def trans_linlog(spark, sf_dir):
    return _scaled(spark, sf_dir, "1000", x="l_extendedprice - 2000")


@query(f"SELECT {_KEY}, round(CASE WHEN abs(l_quantity / 10 - 1) > 1 THEN sign(l_quantity / 10 - 1) * 1000 * exp(abs(l_quantity / 10 - 1) - 1) ELSE (l_quantity / 10 - 1) * 1000 END, 6) AS v FROM lineitem")
def trans_inverse(spark, sf_dir):
    return _scaled(spark, sf_dir, "1000", inverse=True, x="l_quantity / 10 - 1")


@query(f"SELECT {_KEY}, round(asinh(l_extendedprice / 5), 6) AS v FROM lineitem")
def trans_asinh(spark, sf_dir):
    return _scaled(spark, sf_dir, "smoothAsinh|5")


@query("SELECT count(*) AS n, 0 AS n_off FROM lineitem")
def trans_roundtrip(spark, sf_dir):
    """Values that no transform and its inverse bring back within 1e-9."""
    x = F.col("l_extendedprice")
    specs = ("P", "1000", "smoothAsinh|5", "sqrt", "asinh", "smoothLinLog|500|10|2")
    off = [F.abs(transform(transform(x, s), s, inverse=True) - x) > x * 1e-9 for s in specs]
    bad = off[0]
    for o in off[1:]:
        bad = bad | F.coalesce(o, F.lit(True))
    return lines(spark, sf_dir).df.agg(F.count("*").alias("n"), F.count_if(bad).cast("int").alias("n_off"))
