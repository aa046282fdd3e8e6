"""Queries of edited definitions (renamed, removed, changed), networks, channels and
the smaller column helpers."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import channels, numbers, strings
from ..operators import merge, plotdata
from ..operators import masks as mask_language
from ..operators.catalog import Feature, Graph, Population
from ..operators.gates import Region, ellipse_points
from ..operators.masks import Mask, default_image
from ..operators.populations import member, named
from ..operators.stats import pop_stats as count_pops
from .common import digest, digest_sql, lines, query, table
from .gating import CONVEX_SQL, HIERARCHY_SQL, OVAL_SQL, RECT_SQL, hierarchy


def _edited(objects, catalog):
    return objects.edit(catalog)


@query(digest_sql({"Gate": HIERARCHY_SQL["Rect"], "Inner": HIERARCHY_SQL["Poly"], "Rest": HIERARCHY_SQL["Rest"]}))
def pop_rename(spark, sf_dir):
    """Renamed populations keep their members, also in definitions that name them."""
    objects = hierarchy(spark, sf_dir)
    return digest(_edited(objects, objects.catalog.rename_pops({"Rect": "Gate", "Poly": "Inner"})), ["Gate", "Inner", "Rest"])


@query(" UNION ALL ".join(f"SELECT '{p}' AS population, count(*) FILTER ({HIERARCHY_SQL[p]}) AS count FROM lineitem" for p in ("All", "Oval", "Cheap", "Tagged")))
def pop_remove(spark, sf_dir):
    """A removed population takes along all that depend on it."""
    objects = hierarchy(spark, sf_dir)
    left = objects.remove(pops=["Rect"], list_only=False)
    return count_pops(left).select("population", "count")


@query(digest_sql({"Rect": "l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 2000 AND 50000", "Poly": f"l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 2000 AND 50000 AND {CONVEX_SQL}"}))
def region_modify(spark, sf_dir):
    """A changed region under a new label moves the populations on it and below."""
    objects = hierarchy(spark, sf_dir)
    cat = objects.catalog.modify_regions(rect=Region("narrow", "rect", (10.0, 20.0), (2000.0, 50000.0)))
    return digest(_edited(objects, cat), ["Rect", "Poly"])


@query(digest_sql({"Rest": f"({RECT_SQL}) AND ({OVAL_SQL})", "Tagged": "(l_orderkey * 8 + l_linenumber) IN (9, 10)"}))
def pop_modify(spark, sf_dir):
    """Another definition, and other ids, for populations that stay."""
    objects = hierarchy(spark, sf_dir)
    pops = objects.catalog.pops
    return digest(_edited(objects, objects.catalog.modify_pops(Rest=replace(pops["Rest"], definition="Rect|And|Oval"), Tagged=replace(pops["Tagged"], ids=(9, 10)))), ["Rest", "Tagged"])


@query(digest_sql({"Cheap": HIERARCHY_SQL["Cheap"]}))
def feature_rename(spark, sf_dir):
    """Features renamed where definitions and gates name them."""
    objects = hierarchy(spark, sf_dir)
    return digest(objects.rename_features({"unit price": "price of one"}), ["Cheap"])


@query("SELECT population, level, count FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS population, {d} AS level, count(*) FILTER ({HIERARCHY_SQL[p]}) AS count FROM lineitem" for p, d in (("All", 0), ("Rect", 1), ("Poly", 2), ("Oval", 1), ("Cheap", 1), ("Rest", 3), ("Tagged", 1))) + ")")
def pop_network(spark, sf_dir):
    """Nodes of the population network with their depth and counts."""
    nodes, _ = plotdata.network(hierarchy(spark, sf_dir))
    return nodes.select("population", "level", "count")


@query(" UNION ALL ".join(f"SELECT 'Oval' AS pop, '{p}' AS sibling, count(*) AS both FROM lineitem WHERE {c}" for p, c in (("Oval", OVAL_SQL), ("Side", f"{OVAL_SQL} AND l_extendedprice BETWEEN 0 AND 5000 AND l_discount BETWEEN 0 AND 0.05"))))
def pop_siblings(spark, sf_dir):
    """Gates of the same base on the same axes, from the graph that shows them, with the rows they share."""
    objects = hierarchy(spark, sf_dir)
    side = Region("side", "rect", (0.0, 5000.0), (0.0, 0.05), xtrans="1000")
    objects = objects.add_regions(side).add_pops(replace(objects.catalog.pops["Oval"], name="Side", region="side"))
    graph = plotdata.sibling_graph(objects, "Oval")
    assert set(graph.regions) == {"oval", "side"}
    counts = objects.members(list(graph.shown)).agg(*(F.count_if(member("Oval") & member(s)).alias(s) for s in graph.shown))
    return counts.select(F.inline(F.array(*(F.struct(F.lit("Oval").alias("pop"), F.lit(s).alias("sibling"), F.col(s).alias("both")) for s in graph.shown))))


@query(f"SELECT 0 AS place, 'histogram' AS type, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'density', count(*) FILTER ({HIERARCHY_SQL['Rect']}) FROM lineitem")
def graph_edits(spark, sf_dir):
    """Graphs added and removed by their place, and how many rows those that stay show."""
    objects = hierarchy(spark, sf_dir)
    cat = objects.catalog.add_graphs(Graph("histogram", "l_quantity"), Graph("scatter", "l_quantity", "l_tax"), Graph("density", "l_quantity", "l_tax", base=("Rect",)))
    left = cat.remove_graphs([1]).graphs
    counts = objects.members(list({g.base[0] for g in left})).agg(*(F.count_if(member(g.base[0])).alias(f"n{i}") for i, g in enumerate(left)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(g.type).alias("type"), F.col(f"n{i}").alias("n")) for i, g in enumerate(left)))))


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def bind_tables(spark, sf_dir):
    """Columns of two tables of the same objects."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderstatus")
    return merge.bind_columns(left, right, ["l_orderkey"])


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS level FROM part")
def color_level(spark, sf_dir):
    """A feature over its range, as colour."""
    return plotdata.feature_level(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", F.round("level", 6).alias("level"))


@query("SELECT i, x, y, (SELECT count(*) FROM lineitem WHERE l_quantity = floor(x)) AS n FROM (SELECT i, round(25 + 20 * cos(2 * pi() * i / 99), 6) + 0.0 AS x, round(10 + 5 * sin(2 * pi() * i / 99), 6) + 0.0 AS y FROM range(100) t(i))")
def ellipse_outline(spark, sf_dir):
    """The outline of an ellipse, and how many rows have the whole part of each point's x."""
    points = ellipse_points(Region("e", "oval", (5.0, 45.0), (5.0, 15.0)))
    outline = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i long, x double, y double").select("i", (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("y", 6) + F.lit(0.0)).alias("y"))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return outline.join(counts, F.floor("x") == F.col("l_quantity"), "left").select("i", "x", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey, round(ln(0.5::DOUBLE) / ln((p_size + 1.0::DOUBLE) / 100), 6) AS gamma FROM part")
def display_gamma(spark, sf_dir):
    """The exponent that shows a middle value at half brightness."""
    gamma = numbers.gamma_of(F.lit(0.0), F.lit(100.0), F.col("p_size") + F.lit(1.0), F.lit(127.5))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(gamma, 6).alias("gamma"))


@query("SELECT c_custkey, c_name || ' < ' || c_mktsegment || ' >' AS label, c_name AS short, c_mktsegment AS stain, replace(replace(c_mktsegment || ' <&> ''q''', '&', '&amp;'), '<', '&lt;') AS xml0, contains(c_mktsegment, 'BUILD') OR contains(c_mktsegment, 'AUTO') AS hit, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS sign FROM customer")
def text_helpers(spark, sf_dir):
    """Names of parameters, escaped text and searches."""
    label = F.concat("c_name", F.lit(" < "), "c_mktsegment", F.lit(" >"))
    short, stain = strings.fcs_name(label)
    xml = strings.escaped_xml(F.concat("c_mktsegment", F.lit(" <&> 'q'")))
    plain = F.replace(F.replace(xml, F.lit("&gt;"), F.lit(">")), F.lit("&apos;"), F.lit("'"))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), short.alias("short"), stain.alias("stain"), plain.alias("xml0"), strings.contains_any(F.col("c_mktsegment"), ["BUILD", "AUTO"]).alias("hit"), (F.col("c_acctbal") < 0).cast("int").alias("sign"))


@query("SELECT p_partkey, list_position(string_split(p_name, ' '), string_split(p_name, ' ')[2]) AS second, len(string_split(p_name, ' ')) AS n FROM part WHERE len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' ')) AND len(string_split(p_name, ' ')) > 1 UNION ALL SELECT -1, 2, 4")
def token_runs(spark, sf_dir):
    """Places of tokens in names."""
    words = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").filter((F.size(F.array_distinct(words)) == F.size(words)) & (F.size(words) > 1))
    own = rows.select("p_partkey", F.array_position(words, F.get(words, F.lit(1))).alias("second"), F.size(words).cast("long").alias("n"))
    fixed = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), strings.sequence_position(F.array(*map(F.lit, "abca")), ["b", "c"]).cast("long").alias("second"), F.size(strings.sequence_replaced(F.array(*map(F.lit, "abca")), ["b", "c"], ["x", "y"])).cast("long").alias("n"))
    return own.unionByName(fixed)


_OWN = "'Object(M0' || l_linenumber || ',Ch0' || l_linenumber || ',Tight)'"


@query(f"SELECT l_linenumber, l_returnflag, count(*) AS n, 'Intensity' AS family, {_OWN} AS mask, 'Ch0' || l_linenumber AS image, 'Intensity_Object(M0' || b || ',Ch0' || b || ',Tight)_Ch0' || b AS swapped FROM (SELECT *, CASE l_linenumber WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE l_linenumber END AS b FROM lineitem) GROUP BY l_linenumber, l_returnflag, b")
def channel_names(spark, sf_dir):
    """Parts of features' names, and two channels swapped in them, for the name that each row has."""
    n = F.col("l_linenumber").cast("string")
    mask = F.concat(F.lit("Object(M0"), n, F.lit(",Ch0"), n, F.lit(",Tight)"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", F.concat(F.lit("Intensity_"), mask, F.lit("_Ch0"), n).alias("name"))
    masks, pictures = {f"Object(M0{i},Ch0{i},Tight)" for i in range(1, 10)}, {f"Ch0{i}" for i in range(1, 10)}

    def run(batches):
        for b in batches:
            names = b.column("name").to_pylist()
            told = {n: (*channels.feature_parts(n, masks, pictures), channels.with_channels(n, {3: 4, 4: 3})) for n in set(names)}
            assert all(channels.feature_name(*t[:3]) == n for n, t in told.items())
            parts = [pa.array([told[n][i] for n in names], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("l_linenumber"), b.column("l_returnflag"), *parts], names=["l_linenumber", "l_returnflag", "family", "mask", "image", "swapped"])

    told = rows.mapInArrow(run, "l_linenumber int, l_returnflag string, family string, mask string, image string, swapped string")
    return told.groupBy("l_linenumber", "l_returnflag", "family", "mask", "image", "swapped").agg(F.count("*").alias("n"))


def _channels(spark, sf_dir):
    """lineitem as features of two channels, with masks, a ratio and gates on them."""
    quantity, price, area = "Intensity_M01_Ch01", "Intensity_M02_Ch02", "Area_Dilate(M02, 3)"
    objects = lines(spark, sf_dir)
    df = objects.df.withColumnsRenamed({"l_quantity": quantity, "l_extendedprice": price, "l_discount": area})
    cat = replace(objects.catalog, features={})
    cat = cat.add_images(*(default_image(c) for c in (1, 2, 3))).add_masks(Mask("MC", "M01|Or|M02|Or|M03"), Mask("Dilate(M02, 3)", "Dilate|M02|3"))
    cat = cat.add_features(Feature(quantity), Feature(price), Feature(area), Feature(f"{price} / {quantity}", "combined", f"{price}|/|{quantity}"))
    cat = cat.add_regions(Region("q", "line", (10.0, 30.0)), Region("u", "line", (0.0, 1500.0)), Region("d", "line", (0.04, 0.08)))
    cat = cat.add_pops(Population("Many", region="q", fx=quantity), Population("Cheap", base="Many", region="u", fx=f"{price} / {quantity}"), Population("Low", region="d", fx=area), Population("Both", definition="Cheap|And|Low"))
    return replace(objects, df=df, catalog=cat)


_CHANNEL_POPS = {"Many": "l_quantity BETWEEN 10 AND 30", "Cheap": "l_quantity BETWEEN 10 AND 30 AND l_extendedprice / l_quantity BETWEEN 0 AND 1500", "Low": "l_discount BETWEEN 0.04 AND 0.08", "Both": "l_quantity BETWEEN 10 AND 30 AND l_extendedprice / l_quantity BETWEEN 0 AND 1500 AND l_discount BETWEEN 0.04 AND 0.08"}


def _sums(pops: dict[str, str], columns: dict[str, str]) -> str:
    """SQL of ``_digest``: by population, sums of features under their new names."""
    return " UNION ALL ".join(f"SELECT '{p}' AS population, count(*) AS n, '{name}' AS feature, round(sum({x}), 2) AS total FROM lineitem WHERE {c}" for p, c in pops.items() for name, x in columns.items())


def _digest(objects, pops, names):
    rows = objects.members(pops, keep=names)
    of = F.explode(F.filter(F.array(*(F.when(member(p), F.lit(p)) for p in pops)), lambda p: p.isNotNull())).alias("population")
    sums = rows.select(of, *(named(n) for n in names)).groupBy("population").agg(F.count("*").alias("n"), *(F.sum(named(n)).alias(f"s{i}") for i, n in enumerate(names)))
    return sums.select("population", "n", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.round(f"s{i}", 2).alias("total")) for i, n in enumerate(names)))).alias("x")).select("population", "n", "x.*")


_RATIO = "l_extendedprice / l_quantity"


@query(_sums(_CHANNEL_POPS, {"Intensity_M02_Ch02": "l_quantity", "Intensity_M01_Ch01": "l_extendedprice", "Area_Dilate(M01, 3)": "l_discount", "Intensity_M01_Ch01 / Intensity_M02_Ch02": _RATIO}))
def channel_swap(spark, sf_dir):
    """Two channels in each other's place: masks, features, ratios and gates follow, members stay."""
    objects = _channels(spark, sf_dir)
    moved = objects.redefined(objects.catalog.swap_channels(1, 2))
    return _digest(moved, list(_CHANNEL_POPS), ["Intensity_M02_Ch02", "Intensity_M01_Ch01", "Area_Dilate(M01, 3)", "Intensity_M01_Ch01 / Intensity_M02_Ch02"])


@query(_sums({"Low": _CHANNEL_POPS["Low"], "Many": "l_extendedprice BETWEEN 10 AND 30000"}, {"Intensity_M01_Ch01": "l_extendedprice", "Area_Dilate(M01, 3)": "l_discount"}))
def channel_switch(spark, sf_dir):
    """One channel in place of another: what becomes equal is one feature, with the moved values, and gates on it see them."""
    objects = _channels(spark, sf_dir)
    objects = objects.edit(objects.catalog.modify_regions(q=Region("q", "line", (10.0, 30000.0))))
    moved = objects.redefined(objects.catalog.switch_channel(2, 1))
    assert "Intensity_M02_Ch02" not in moved.catalog.features
    return _digest(moved, ["Low", "Many"], ["Intensity_M01_Ch01", "Area_Dilate(M01, 3)"])


@query(_sums(_CHANNEL_POPS, {"Intensity_M02_CD4": "l_extendedprice", "Area_Dilate(M02, 3)": "l_discount", "Intensity_M02_CD4 / Intensity_M01_Ch01": _RATIO}))
def image_rename(spark, sf_dir):
    """Another name for an image, in features, ratios and gates."""
    objects = _channels(spark, sf_dir)
    moved = objects.redefined(objects.catalog.redefine(images={"Ch02": "CD4"}))
    return _digest(moved, list(_CHANNEL_POPS), ["Intensity_M02_CD4", "Area_Dilate(M02, 3)", "Intensity_M02_CD4 / Intensity_M01_Ch01"])


_STEP = "(l_linenumber % 7 + 1)"
_CH = f"printf('%02d', {_STEP})"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, 'Threshold(Intensity(M' || {_CH} || ', Ch' || {_CH} || ', ' || l_quantity::INT || '-4095), Ch' || {_CH} || ', ' || {_STEP} || ')' AS name, 'Threshold|Intensity(M' || {_CH} || ', Ch01, ' || l_quantity::INT || '-4095)|Ch01|' || {_STEP} AS moved, 'M' || {_CH} AS own FROM lineitem")
def mask_names(spark, sf_dir):
    """Nested mask definitions, one for each row: parsed, named, and with another image at their leaves."""
    two = F.lpad((F.col("l_linenumber") % 7 + 1).cast("string"), 2, "0")
    inner = F.concat(F.lit("Intensity(M"), two, F.lit(", Ch"), two, F.lit(", "), F.col("l_quantity").cast("int").cast("string"), F.lit("-4095)"))
    definition = F.concat(F.lit("Threshold|"), inner, F.lit("|Ch"), two, F.lit("|"), (F.col("l_linenumber") % 7 + 1).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", definition.alias("definition"))
    images = {f"Ch{c:02d}": "Ch01" for c in range(1, 8)}
    told = mask_language.read_definitions(rows, "definition", images=images)
    return told.select("l_orderkey", "l_linenumber", "l_quantity", "name", F.col("rewritten").alias("moved"), F.element_at("masks", 1).alias("own"))
