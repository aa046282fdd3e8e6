"""Queries of merges, ids, groups and compensation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..operators.catalog import Catalog, Feature, Population
from ..operators.gates import Region
from ..operators.populations import Objects, Strategy, apply_strategy, rebuilt_ids
from .common import LINE_ID, digest, digest_sql, lines, query, table


@query(
    "SELECT c_custkey, c_name, c_mktsegment, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS import_file FROM customer "
    "UNION ALL SELECT NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier"
)
def merge_by_name(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_acctbal": "balance"})
    supplier = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_nationkey": "nation", "s_acctbal": "balance"})
    return merge.merge_by_name({"customer": customer, "supplier": supplier})


@query("SELECT c_custkey AS s_suppkey, c_acctbal AS c_acctbal_total, 'customer' AS import_file FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def merge_by_position(spark, sf_dir):
    """Columns by place; of two names the longer stays."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("c_acctbal_total"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return merge.merge_by_position({"customer": customer, "supplier": supplier})


@query(
    "SELECT event_id, (sum(changed) OVER (PARTITION BY event_id % 3 ORDER BY event_id))::BIGINT AS object_number FROM (SELECT event_id, CASE WHEN lag(event_id) OVER w IS NULL THEN 0 "
    "WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR user_id % 7 IS DISTINCT FROM lag(user_id % 7) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY event_id))"
)
def object_id_rebuild(spark, sf_dir):
    """Running ids per file that grow where any key changes (gaps and islands)."""
    df = table(spark, sf_dir, "events").withColumns({"camera": F.col("user_id") % 7, "file": F.col("event_id") % 3})
    return rebuilt_ids(df, ["event_type", "camera"], "event_id", file_col="file", span=4096).select("event_id", "object_number")


@query("SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL GROUP BY ALL")
def group_tuple(spark, sf_dir):
    return merge.tuple_groups(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS code FROM part")
def factor_codes(spark, sf_dir):
    return merge.factor_codes(table(spark, sf_dir, "part"), "p_type").select("p_partkey", "code")


#: Share of a row's signal that is seen in each column.
SPILL = {"l_quantity": {"l_quantity": 1.0, "l_discount": 0.002, "l_tax": 0.001}, "l_discount": {"l_quantity": 0.5, "l_discount": 1.0, "l_tax": 0.25}, "l_tax": {"l_quantity": 0.0, "l_discount": 0.125, "l_tax": 1.0}}


def _inverse() -> list[list[float]]:
    import numpy as np

    names = list(SPILL)
    return np.linalg.inv(np.array([[SPILL[a][b] for b in names] for a in names])).tolist()


_COLS = [" + ".join(f"{a} * {_inverse()[i][j]!r}" for i, a in enumerate(SPILL)) for j in range(3)]


@query(f"SELECT {LINE_ID} AS object_number, " + ", ".join(f"CASE WHEN round({c}, 6) = 0 THEN 0.0::DOUBLE ELSE round({c}, 6) END AS {a}" for c, a in zip(_COLS, SPILL)) + " FROM lineitem")
def compensation(spark, sf_dir):
    df = merge.compensate(lines(spark, sf_dir).df, SPILL)
    return df.select("object_number", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in SPILL))  # no -0


@query(digest_sql({"low": "l_extendedprice / l_quantity < 1400 AND q <= 30", "kept": "l_extendedprice >= 60000"}, f"(SELECT *, {_COLS[0]} AS q FROM lineitem)"))
def strategy_apply(spark, sf_dir):
    """A saved strategy (spillover, combined feature, gates) on another table,
    with one of that table's own populations kept."""
    cat = Catalog().add_features(*(Feature(n) for n in ("l_quantity", "unit price")))
    cat = cat.add_regions(Region("q", "line", (float("-inf"), 30.0)), Region("d", "line", (1400.0, 1400.0), sync="dual_d|1"), Region("e", "line", (1400.0, 1400.0), sync="dual_d|2"))
    cat = cat.add_pops(Population("few", region="q", fx="l_quantity"), Population("low", base="few", region="d", fx="unit price"))
    objects = lines(spark, sf_dir)
    objects = objects.add_regions(Region("own", "line", (60000.0, float("inf")))).add_pops(Population("kept", region="own", fx="l_extendedprice"))
    df = objects.df.withColumn("unit price", F.col("l_extendedprice") / F.col("l_quantity"))
    objects = Objects(df, objects.catalog.add_features(Feature("unit price", "computed")), objects.id_col)
    return digest(apply_strategy(objects, Strategy(cat, SPILL), keep=["kept"]), ["low", "kept"])
