"""Queries that write a table in a file format, read it again and gate it, and
the gates on a stream."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.catalog import Population
from ..operators.gates import Region
from ..operators.populations import Objects, Strategy, apply_strategy
from ..operators.stats import pop_stats as count_pops
from ..operators.store import new_path
from ..sources import fcs, files, gatingml
from ..streaming.gates import windowed_counts
from .common import digest, digest_sql, lines, query, table
from .gating import HIERARCHY_SQL, TAGS, hierarchy


def _place(spark) -> str:
    """A folder that driver and executors share."""
    return new_path(spark, "files")


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, round(p_retailprice::FLOAT::DOUBLE, 3) AS p_retailprice, CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS big FROM part")
def fcs_roundtrip(spark, sf_dir):
    """Features and a population written as FCS files and read again."""
    folder = _place(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    fcs.write_fcs(part, folder, pops={"big": F.col("p_size") > 25}).collect()
    return fcs.read_fcs(spark, f"{folder}/*.fcs").select("p_partkey", "p_size", F.round("p_retailprice", 3).alias("p_retailprice"), "big")


@query(digest_sql({k: HIERARCHY_SQL[k] for k in ("Rect", "Poly", "Oval", "Rest", "Tagged")}))
def gatingml_roundtrip(spark, sf_dir):
    """Gates written as GatingML, read again and applied."""
    cat = hierarchy(spark, sf_dir).catalog
    cat = cat.remove(cat.removal(pops=["Cheap"]))
    again = gatingml.parse(gatingml.render(Strategy(replace(cat, features={}))))
    assert again.catalog.pops["Tagged"].ids == TAGS
    return digest(apply_strategy(lines(spark, sf_dir), again), ["Rect", "Poly", "Oval", "Rest", "Tagged"])


def _events(spark, sf_dir, df) -> Objects:
    objects = Objects.of(df, id_col="event_id", features=("value",))
    return objects.add_regions(Region("h", "line", (50.0, float("inf")))).add_pops(Population("high", region="h", fx="value"))


@query("SELECT floor(epoch(ts) / 21600)::BIGINT AS slot, count(*) AS total, count(*) FILTER (value >= 50) AS n_high FROM events GROUP BY ALL")
def stream_gate(spark, sf_dir):
    """A stream of events gated and counted in windows of six hours."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.expr("convert_timezone('UTC', current_timezone(), ts)"))  # times are in UTC
    out, folder = windowed_counts(stream, _events(spark, sf_dir, stream), ["high"], "ts", "6 hours", "3650 days"), _place(spark)
    name = f"counts_{uuid.uuid4().hex}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select((F.col("start").cast("long") / 21600).cast("long").alias("slot"), "total", "n_high")


@query("SELECT population, count FROM (SELECT 'All' AS population, count(*) AS count FROM events UNION ALL SELECT 'high', count(*) FROM events WHERE value >= 50)")
def batch_gate(spark, sf_dir):
    return count_pops(_events(spark, sf_dir, table(spark, sf_dir, "events"))).select("population", "count")


@query(digest_sql({n: HIERARCHY_SQL[n] for n in ("Rect", "Poly", "Oval", "Cheap", "Rest")} | {"d_1": "l_quantity < 25", "q_3": "l_quantity >= 25 AND l_discount < 0.05"}))
def template_apply(spark, sf_dir):
    """Gates saved as a template file and as a GatingML file, read by extension and applied to
    objects: the combined feature from the first, groups of regions from both."""
    place = new_path(spark, "gates")
    whole = hierarchy(spark, sf_dir)
    cat = whole.catalog.add_group(Region("d", "line", (25.0, 30.0)), "dual", fx="l_quantity")
    whole = whole.edit(cat.add_group(Region("q", "rect", (25.0, 30.0), (0.05, 0.1)), "quad", fx="l_quantity", fy="l_discount"))
    files.write_gates(whole.remove(pops=["Tagged"], list_only=False), f"{place}/all.ast")
    cat = whole.catalog
    files.write_gates(Strategy(replace(cat.remove(cat.removal(pops=["Tagged", "Cheap"])), features={})), f"{place}/some.xml")
    objects = apply_strategy(lines(spark, sf_dir), files.read(spark, f"{place}/all.ast"))
    objects = apply_strategy(objects, files.read(spark, f"{place}/some.xml"), keep=["Cheap"])
    return digest(objects, ["Rect", "Poly", "Oval", "Cheap", "Rest", "d_1", "q_3"])
