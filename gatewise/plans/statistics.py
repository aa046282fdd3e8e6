"""Queries of feature statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import Population
from ..operators.gates import Region
from ..operators.populations import Objects
from ..operators.stats import SUMMARY, ReportRow, feature_stats, report
from ..operators.stats import pop_stats as count_pops
from .common import lin_log_sql, lines, query, table
from .gating import HIERARCHY_SQL, hierarchy


def _summary_sql(v: str, condition: str, source: str) -> str:
    return (
        f"count({v}) AS n, min({v}) AS \"min\", quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median, avg({v}) AS mean, quantile_cont({v}, 0.75) AS q3, max({v}) AS \"max\", "
        f"1.4826 * mad({v}) AS mad, stddev_samp({v}) AS sd, var_samp({v}) AS var, 0::BIGINT AS n_nan FROM {source} WHERE {condition}"
    )


def _rounded(sql: str) -> str:
    cols = ", ".join(f'round("{c}", 4) AS "{c}"' for c in SUMMARY)
    return f"SELECT population, feature, n, {cols}, n_nan FROM ({sql})"


def _round(df):
    return df.withColumns({c: F.round(c, 4) for c in SUMMARY})


@query(_rounded(" UNION ALL ".join(f"SELECT '{p}' AS population, '{f}' AS feature, {_summary_sql(f, HIERARCHY_SQL[p], 'lineitem')}" for p in ("All", "Rect", "Rest") for f in ("l_extendedprice", "l_quantity"))))
def stats_feature(spark, sf_dir):
    """Six numbers, MAD, sd and variance per population and feature, exactly."""
    return _round(feature_stats(hierarchy(spark, sf_dir), ["l_extendedprice", "l_quantity"], ["All", "Rect", "Rest"]))


@query(_rounded(f"SELECT 'All' AS population, 'value' AS feature, {_summary_sql(lin_log_sql('value', 10.0), 'true', 'events')}"))
def stats_transformed(spark, sf_dir):
    objects = Objects.of(table(spark, sf_dir, "events"), id_col="event_id", features=("value",))
    return _round(feature_stats(objects, ["value"], trans={"value": "10"}))


REPORT = (
    ("n", "Count", "Rect", "", ""),
    ("mean", "Mean", "Rect", "l_extendedprice", ""),
    ("total", "%Total", "Poly", "", ""),
    ("gated", "%Gated", "Poly", "", ""),
    ("ratio", "%", "Poly", "", "Oval"),
    ("rd mean", "RD - Mean", "Poly", "l_extendedprice", "Oval"),
    ("median", "Median", "Rest", "l_extendedprice", ""),
    ("cv", "CV", "Rect", "l_quantity", ""),
    ("sd", "stddev", "Rect", "l_quantity", ""),
    ("nan", "NaN", "Rect", "l_quantity", ""),
    ("mad", "MAD", "Oval", "l_extendedprice", ""),
    ("least", "min", "Poly", "l_extendedprice", ""),
    ("rd median", "RD - Median", "Poly", "l_extendedprice", "Oval"),
    ("var", "Variance", "Rect", "l_quantity", ""),
    ("most", "max", "Poly", "l_extendedprice", ""),
    ("geo", "geomean", "Oval", "l_extendedprice", ""),
)


def _report_sql() -> str:
    f = lambda p: f"FILTER ({HIERARCHY_SQL[p]})"
    e = "l_extendedprice"
    value = {
        "n": f"count(*) {f('Rect')}",
        "mean": f"avg({e}) {f('Rect')}",
        "total": f"100.0::DOUBLE * count(*) {f('Poly')} / count(*)",
        "gated": f"100.0::DOUBLE * count(*) {f('Poly')} / count(*) {f('Rect')}",
        "ratio": f"100.0::DOUBLE * count(*) {f('Poly')} / count(*) {f('Oval')}",
        "rd mean": f"abs(avg({e}) {f('Poly')} - avg({e}) {f('Oval')}) / (stddev_samp({e}) {f('Poly')} + stddev_samp({e}) {f('Oval')})",
        "median": f"median({e}) {f('Rest')}",
        "cv": f"100 * stddev_samp(l_quantity) {f('Rect')} / avg(l_quantity) {f('Rect')}",
        "sd": f"stddev_samp(l_quantity) {f('Rect')}",
        "nan": "0 * count(*)",
        "mad": f"1.4826 * mad({e}) {f('Oval')}",
        "least": f"min({e}) {f('Poly')}",
        "rd median": f"abs(median({e}) {f('Poly')} - median({e}) {f('Oval')}) / (1.4826 * (mad({e}) {f('Poly')} + mad({e}) {f('Oval')}))",
        "var": f"var_samp(l_quantity) {f('Rect')}",
        "most": f"max({e}) {f('Poly')}",
        "geo": f"exp(avg(ln({e})) {f('Oval')})",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round(({v})::DOUBLE, 4) AS value FROM lineitem" for k, v in value.items())


@query(_report_sql())
def stats_report(spark, sf_dir):
    """Every statistic of the report vocabulary that has a value."""
    rows = [ReportRow(n, s, p, f, q) for n, s, p, f, q in REPORT]
    return report(hierarchy(spark, sf_dir), rows).withColumn("value", F.round("value", 4))


_BY = (("n", "Count", "mid", ""), ("share", "%Total", "mid", ""), ("mean", "Mean", "mid", "o_totalprice"), ("median", "Median", "mid", "o_totalprice"), ("mad", "MAD", "mid", "o_totalprice"), ("sd", "stddev", "mid", "o_totalprice"))
_MID = "o_totalprice BETWEEN 50000 AND 200000"


def _orders(spark, sf_dir) -> Objects:
    objects = Objects.of(table(spark, sf_dir, "orders"), id_col="o_orderkey", file_col="o_orderpriority", features=("o_totalprice",))
    return objects.add_regions(Region("m", "line", (50000.0, 200000.0))).add_pops(Population("mid", region="m", fx="o_totalprice"))


_BY_SQL = {"n": "count(*)::DOUBLE", "share": "100.0::DOUBLE * count(*) / any_value(total)", "mean": "avg(o_totalprice)", "median": "median(o_totalprice)", "mad": "1.4826 * mad(o_totalprice)", "sd": "stddev_samp(o_totalprice)"}


@query("WITH t AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders) " + " UNION ALL ".join(f"SELECT o_orderpriority, '{k}' AS name, round({v}, 4) AS value FROM t WHERE {_MID} GROUP BY o_orderpriority" for k, v in _BY_SQL.items()))
def stats_report_by_file(spark, sf_dir):
    """The same report for each file of a merged table, in one plan."""
    return report(_orders(spark, sf_dir), [ReportRow(n, s, p, f) for n, s, p, f in _BY], by="o_orderpriority").withColumn("value", F.round("value", 4))


@query(
    "WITH c AS (SELECT o_orderpriority, count(*) AS t, count(*) FILTER (" + _MID + ") AS n FROM orders GROUP BY o_orderpriority) "
    "SELECT o_orderpriority, 'All' AS population, 'B' AS type, '' AS parent, t AS count, 100.0::DOUBLE AS perc_parent, 100.0::DOUBLE AS perc_tot FROM c "
    "UNION ALL SELECT o_orderpriority, 'mid', 'G', 'All', n, 100.0::DOUBLE * n / t, 100.0::DOUBLE * n / t FROM c"
)
def pop_stats_by_file(spark, sf_dir):
    return count_pops(_orders(spark, sf_dir), by="o_orderpriority")


@query("SELECT 'All' AS population, 'v' AS feature, 1::BIGINT AS n, 7.0::DOUBLE AS \"min\", 7.0::DOUBLE AS \"max\", 0.0::DOUBLE AS sd, 0.0::DOUBLE AS var, 0.0::DOUBLE AS mad, count(*) - 1 AS n_nan FROM part")
def stats_single_value(spark, sf_dir):
    """One finite value beside NaN, infinite and missing ones."""
    odd = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 3 == 1, F.lit(float("inf")))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_number"), F.when(F.col("p_partkey") == 1, F.lit(7.0)).otherwise(odd).alias("v"))
    return feature_stats(Objects.of(df, features=("v",)), ["v"]).select("population", "feature", "n", "min", "max", "sd", "var", "mad", "n_nan")
