"""Tables and pieces that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import edges
from ..operators.populations import Objects, member

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An object number of lineitem (line numbers are below 8; some rows share one).
LINE_ID = "(l_orderkey * 8 + l_linenumber)"
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lines(spark: SparkSession, sf_dir: str) -> Objects:
    """lineitem as objects with four features."""
    df = table(spark, sf_dir, "lineitem").withColumn("object_number", F.expr(LINE_ID))
    return Objects.of(df, features=LINE_FEATURES)


def digest(objects: Objects, pops: list[str]) -> DataFrame:
    """population, l_returnflag, n, key_sum: the rows that are in, compactly."""
    rows = objects.members(pops)
    of = F.explode(F.filter(F.array(*(F.when(member(p), F.lit(p)) for p in pops)), lambda p: p.isNotNull())).alias("population")
    return rows.select(of, "l_returnflag", "object_number").groupBy("population", "l_returnflag").agg(F.count("*").alias("n"), F.sum("object_number").alias("key_sum"))


def digest_sql(conditions: dict[str, str], source: str = "lineitem") -> str:
    """The same in SQL, from a condition per population."""
    parts = [f"SELECT '{p}' AS population, l_returnflag, count(*) AS n, sum({LINE_ID})::BIGINT AS key_sum FROM {source} WHERE {c} GROUP BY l_returnflag" for p, c in conditions.items()]
    return " UNION ALL ".join(parts)


def lin_log_sql(x: str, hyper: float) -> str:
    return f"(CASE WHEN abs({x}) <= {hyper} THEN {x} / {hyper} ELSE sign({x}) * (1 + ln(abs({x}) / {hyper})) END)"


def inside_sql(x: str, y: str, xs: list[float], ys: list[float]) -> str:
    """Winding number of a polygon that no point lies on."""
    turns = []
    for x1, y1, x2, y2 in edges(xs, ys):
        side = f"(({x2!r} - {x1!r}) * ({y} - {y1!r}) - ({x} - {x1!r}) * ({y2!r} - {y1!r}))"
        if y1 < y2:
            turns.append(f"CASE WHEN {y1!r} <= {y} AND {y2!r} > {y} AND {side} > 0 THEN 1 ELSE 0 END")
        elif y2 < y1:
            turns.append(f"CASE WHEN {y1!r} > {y} AND {y2!r} <= {y} AND {side} < 0 THEN -1 ELSE 0 END")
    return f"({' + '.join(turns)}) <> 0"
