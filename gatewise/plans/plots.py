"""Queries of plot data: bins, densities, pixels, region counts, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plotdata
from ..operators.catalog import Graph
from .common import LINE_ID, lines, query, table
from .gating import CONVEX_SQL, RECT_SQL, hierarchy


def _bin_sql(x: str, lo: float, hi: float, bins: int) -> str:
    w = f"(({hi!r}::DOUBLE - {lo!r}::DOUBLE) / {bins})"
    return f"CASE WHEN {x} >= {lo!r} AND {x} <= {hi!r} THEN least(greatest(1, ceil(({x} - {lo!r}) / {w})), {bins})::BIGINT END"


def _hist_sql(x: str) -> str:
    return f'SELECT bin, count, percent FROM (SELECT bin, count(*) AS count, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM (SELECT {_bin_sql(x, 2000.5, 60000.5, 520)} AS bin FROM lineitem) GROUP BY bin) WHERE bin IS NOT NULL'


@query(_hist_sql("l_extendedprice"))
def hist_count(spark, sf_dir):
    """Right-closed bins; what lies outside counts for percents alone."""
    return plotdata.histogram(lines(spark, sf_dir).df, F.col("l_extendedprice"), 2000.5, 60000.5)


@query(_hist_sql("greatest(2000.5, least(60000.5, l_extendedprice))"))
def hist_clamped(spark, sf_dir):
    """Values beyond the limits are drawn at the limits."""
    return plotdata.histogram(lines(spark, sf_dir).df, F.col("l_extendedprice"), 2000.5, 60000.5, clamp=True)


_DENSE = f"SELECT xbin, ybin, count(*) AS count FROM (SELECT {_bin_sql('l_extendedprice', 2000.5, 60000.5, 128)} AS xbin, {_bin_sql('l_quantity', 0.5, 50.5, 128)} AS ybin FROM lineitem WHERE {RECT_SQL}) WHERE xbin IS NOT NULL AND ybin IS NOT NULL GROUP BY ALL"


@query(f"SELECT xbin, ybin, count, round(asinh(count::DOUBLE / max(count) OVER ()) / asinh(1), 6) AS level FROM ({_DENSE})")
def density_bins(spark, sf_dir):
    """Counts and colour levels of a population in 128 x 128 bins."""
    graph = Graph("density", "l_extendedprice", "l_quantity", base=("Rect",))
    rows = plotdata.plot_rows(hierarchy(spark, sf_dir), graph)
    return plotdata.density_bins(rows, F.col("x2"), F.col("y2"), (2000.5, 60000.5), (0.5, 50.5)).withColumn("level", F.round("level", 6))


@query(f"SELECT {LINE_ID} AS object_number, round(coalesce(level, 0), 6) AS level FROM (SELECT *, {_bin_sql('l_extendedprice', 2000.5, 60000.5, 128)} AS xbin, {_bin_sql('l_quantity', 0.5, 50.5, 128)} AS ybin FROM lineitem WHERE {RECT_SQL}) LEFT JOIN (SELECT xbin, ybin, asinh(count::DOUBLE / max(count) OVER ()) / asinh(1) AS level FROM ({_DENSE})) USING (xbin, ybin)")
def point_density(spark, sf_dir):
    """The level of the bin that each point of a population lies in."""
    graph = Graph("density", "l_extendedprice", "l_quantity", base=("Rect",))
    rows = plotdata.plot_rows(hierarchy(spark, sf_dir), graph)
    out = plotdata.point_density(rows, F.col("x2"), F.col("y2"), (2000.5, 60000.5), (0.5, 50.5))
    return out.select("object_number", F.round("level", 6).alias("level"))


_PX = "floor(({x} - 1000.0) * (400.0 / 64000.0) + 20.0)::INT"
_PY = "floor(10.0 + 300.0 - ({y} - 0.0) * (300.0 / 0.08))::INT"


def _pixel_sql(x: str, y: str, where: str) -> str:
    return f"SELECT {_PX.format(x=x)} AS px, {_PY.format(y=y)} AS py, count(*) AS count, min({LINE_ID}) AS first FROM lineitem WHERE {where} GROUP BY ALL"


_AT = plotdata.CoordMap((1000.0, 65000.0), (0.0, 0.08), 400, 300, 20.0, 10.0)


@query(_pixel_sql("l_extendedprice", "l_discount", "l_extendedprice BETWEEN 1000 AND 65000 AND l_discount BETWEEN 0 AND 0.08"))
def pixel_bins(spark, sf_dir):
    """Points by pixel, with the one that is drawn; those outside are left out."""
    return plotdata.pixel_bins(lines(spark, sf_dir).df, F.col("l_extendedprice"), F.col("l_discount"), _AT, first=F.col("object_number"))


@query(_pixel_sql("greatest(1000.0, least(65000.0, l_extendedprice))", "greatest(0.0, least(0.08, l_discount))", "true"))
def pixel_bins_edge(spark, sf_dir):
    """The same with points outside drawn at the border."""
    return plotdata.pixel_bins(lines(spark, sf_dir).df, F.col("l_extendedprice"), F.col("l_discount"), _AT, edge=True, first=F.col("object_number"))


@query(
    f"WITH c AS (SELECT count(*) AS a, count(*) FILTER ({CONVEX_SQL}) AS r, count(*) FILTER ({RECT_SQL}) AS s FROM lineitem) "
    "SELECT 'All' AS label, 'All' AS base, a AS count, 100.0::DOUBLE AS perc FROM c UNION ALL SELECT 'All & convex', 'All', r, 100.0::DOUBLE * r / a FROM c UNION ALL SELECT 'All & Rect', 'All', s, 100.0::DOUBLE * s / a FROM c"
)
def region_stats(spark, sf_dir):
    """Counts of a plot's base population, regions and shown populations."""
    graph = Graph("scatter", "l_extendedprice", "l_discount", base=("All",), regions=("convex",), shown=("Rect",), xtrans="1000")
    return plotdata.region_stats(hierarchy(spark, sf_dir), graph)


_WIDE = "0.07 * (max(l_extendedprice) - min(l_extendedprice))"


@query(f"SELECT round(min(l_extendedprice) - {_WIDE}, 4) AS xlo, round(max(l_extendedprice) + {_WIDE}, 4) AS xhi FROM lineitem")
def viewport(spark, sf_dir):
    """Limits of the data, widened by 7 % on either side."""
    graph = Graph("histogram", "l_extendedprice")
    lo, hi = plotdata.viewport(plotdata.plot_rows(lines(spark, sf_dir), graph), graph)["x"]
    return spark.createDataFrame([(round(lo, 4), round(hi, 4))], "xlo double, xhi double")


@query("SELECT n_name AS name, dense_rank() OVER (ORDER BY n_regionkey)::INT AS row, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS \"column\" FROM nation")
def layout_rank(spark, sf_dir):
    """Places in a grid, from locations."""
    df = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y"))
    return plotdata.layout(df).select("name", "row", "column")


@query(f"SELECT least(2000, count(*)) AS n, true AS inside FROM lineitem WHERE {RECT_SQL}")
def plot_sample(spark, sf_dir):
    """A seeded subset of the plotted points."""
    graph = Graph("scatter", "l_quantity", "l_extendedprice", base=("Rect",))
    rows = plotdata.sample_points(plotdata.plot_rows(hierarchy(spark, sf_dir), graph), ["object_number"], 2000)
    inside = F.col("x1").between(5, 40) & F.col("y1").between(2000, 50000)
    return rows.agg(F.count("*").alias("n"), F.every(inside).alias("inside"))
