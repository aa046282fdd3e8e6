"""Statistics of populations and features, and report rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import INF, NAN, finite, is_finite, natural_log
from ..functions.transforms import transform
from .catalog import ALL, STATISTICS, ReportRow
from .populations import Objects, member, named
from .quantiles import order_statistics, sketch
from .store import saved

#: Makes the median of absolute deviations comparable to a standard deviation.
MAD_SCALE = 1.4826
COUNTS = "population string, type string, parent string, count long, perc_parent double, perc_tot double"


def per_cent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(NAN))


def pop_stats(objects: Objects, by: str | None = None) -> DataFrame:
    """population, type, parent, count, perc_parent, perc_tot (for each ``by``).

    All populations are counted in one aggregation of narrow booleans; percents
    of an empty parent are NaN.
    """
    cat = objects.catalog
    names = list(cat.pops)
    keys = [named(by)] if by else []
    counted = objects.members().groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(member(n)).alias(f"n{i}") for i, n in enumerate(names)))
    parents = [cat.pops[n].base or ALL for n in names]
    place = {n: f"n{i}" for i, n in enumerate(names)}
    rows = [
        F.struct(F.lit(n).alias("population"), F.lit(cat.pops[n].type).alias("type"), F.lit("" if cat.pops[n].type == "B" else p).alias("parent"), F.col(place[n]).alias("count"), F.col(place[p]).alias("of"))
        for n, p in zip(names, parents)
    ]
    each = counted.select(*keys, "total", F.inline(F.array(*rows)))
    return each.select(*keys, "population", "type", "parent", "count", per_cent(F.col("count"), F.col("of")).alias("perc_parent"), per_cent(F.col("count"), F.col("total")).alias("perc_tot"))


def _scanned(objects: Objects, features: Sequence[str], pops: Sequence[str], trans: dict[str, str], by: str | None, probs: Sequence[float], spread: bool, infinite: bool) -> DataFrame:
    """A row per ``by`` (g), with the stats of each population and feature (in that
    order) as an array: n, n_bad, n_inf, least, most, mean, var, geomean, q (at
    ``probs``), mad. ``infinite``: infinities are ordered too, as the largest doubles.

    Two scans of the table, whatever the number of populations and features.
    """
    df = objects.members(pops, keep=features)
    g = F.struct(named(by).alias("by")) if by else F.struct(F.lit(0).alias("by"))
    value = {f: transform(named(f).cast("double"), trans.get(f)) for f in features}
    cols = [F.when(member(p), F.coalesce(value[f], F.lit(NAN))).alias(f"v{i * len(features) + j}") for i, p in enumerate(pops) for j, f in enumerate(features)]
    rows = df.select(g.alias("g"), *cols)
    names = [f"v{i}" for i in range(len(cols))]
    big = 1.7976931348623157e308

    def placed(v: Column) -> Column:
        if infinite:
            return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(-big)), F.lit(big)))
        return F.when(is_finite(v), v)

    # Columns become rows, so the plan doesn't grow with populations and features.
    long = rows.select("g", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in enumerate(names)))))
    v = F.col("v")
    each = long.groupBy("g", "k").agg(F.struct(*moments(v), F.count(placed(v)).alias("count"), (sketch(placed(v), probs) if probs else F.lit(None).cast("array<double>")).alias("sketch")).alias("s"))
    first = saved(each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("all")), "stats")
    stats = F.transform("all", lambda x: x["s"].dropFields("sketch")).alias("stats")
    if not probs:
        return first.select("g", stats, F.lit(None).cast("map<int, struct<q: array<double>, mad: double>>").alias("found"))
    sketches = first.select("g", F.transform("all", lambda x: x["s"]["count"]).alias("counts"), F.transform("all", lambda x: x["s"]["sketch"]).alias("sketches"))
    ordered = order_statistics(rows.select("g", *(placed(F.col(v)).alias(v) for v in names)), sketches, names, probs, spread)
    return first.select("g", stats).join(ordered, "g", "left")


def moments(v: Column) -> list[Column]:
    """Aggregates of the rows where ``v`` isn't null (NaN: missing): n, n_bad (NaN or
    infinite), n_inf, least, most, mean, var, geomean of the finite values."""
    x = finite(v)
    n = F.count(x)
    return [
        n.alias("n"),
        F.count_if(v.isNotNull() & ~is_finite(v)).alias("n_bad"),
        F.count_if(F.abs(v) == INF).alias("n_inf"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.avg(x).alias("mean"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.var_samp(x)).alias("var"),
        F.exp(F.avg(finite(natural_log(x)))).alias("geomean"),
    ]


QUARTERS = (0.25, 0.5, 0.75)
SUMMARY = ("min", "q1", "median", "mean", "q3", "max", "mad", "sd", "var")


def feature_stats(objects: Objects, features: Sequence[str], pops: Sequence[str] | None = None, trans: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """Per population and feature (and ``by``): n, min, q1, median, mean, q3, max,
    mad, sd, var of the transformed finite values and n_nan, the number of others.

    Quantiles are exact, from two scans (see ``quantiles``). sd and var of one value
    are 0; of none, all numbers are NaN. The result stays distributed: a group's
    statistics are one row until they are listed.
    """
    pops = list(objects.catalog.pops) if pops is None else list(pops)
    features = list(features)
    rows = _scanned(objects, features, pops, trans or {}, by, QUARTERS, True, False)
    out = []
    for i, p in enumerate(pops):
        for j, f in enumerate(features):
            k = i * len(features) + j
            s, at = F.get("stats", F.lit(k)), F.element_at("found", F.lit(k))
            q = [F.get(at["q"], F.lit(n)) for n in range(3)]
            values = {"min": s["least"], "q1": q[0], "median": q[1], "mean": s["mean"], "q3": q[2], "max": s["most"], "mad": MAD_SCALE * at["mad"], "sd": F.sqrt(s["var"]), "var": s["var"]}
            out.append(F.struct(F.lit(p).alias("population"), F.lit(f).alias("feature"), F.coalesce(s["n"], F.lit(0)).alias("n"), *(F.coalesce(values[c], F.lit(NAN)).alias(c) for c in SUMMARY), F.coalesce(s["n_bad"], F.lit(0)).alias("n_nan")))
    return _listed(rows if by else _one_row(rows), by, out)


def _one_row(rows: DataFrame) -> DataFrame:
    """Also a row where the table is empty."""
    one = rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("by")).alias("g"))
    return one.join(rows, "g", "left")


def _listed(rows: DataFrame, by: str | None, out: list[Column]) -> DataFrame:
    if not by:
        return rows.select(F.inline(F.array(*out)))
    listed = rows.select(F.col("g.by").alias("_by"), F.inline(F.array(*out)))
    return listed.select(F.col("_by").alias(by), *(c for c in listed.columns if c != "_by"))


ORDERED = ("Median", "MAD", "RD - Median")


def report(objects: Objects, rows: Sequence[ReportRow] | None = None, by: str | None = None) -> DataFrame:
    """name, value of each report row (of the catalog's, without ``rows``; for each
    ``by``); what isn't finite is NaN.

    Infinite values count (they make means NaN); NaN and missing ones don't.
    Objects/mL and Mode aren't computed. Unknown names give NaN.
    """
    cat = objects.catalog
    rows = cat.reports if rows is None else rows
    pops = [p for p in dict.fromkeys(x for r in rows for x in (r.population, r.population2)) if p in cat.pops]
    features = [f for f in dict.fromkeys(r.feature for r in rows) if f in cat.features]
    ordered = any(r.statistic in ORDERED for r in rows)
    spread = any(r.statistic in ("MAD", "RD - Median") for r in rows)
    counted = [p for p in dict.fromkeys([ALL, *pops, *(cat.pops[p].base for p in pops)]) if p in cat.pops]
    members = objects.members(counted)
    g = F.struct(named(by).alias("by")) if by else F.struct(F.lit(0).alias("by"))
    table = members.groupBy(g.alias("g")).agg(F.array(*(F.count_if(member(p)) for p in counted)).alias("sizes"))
    if pops and features:
        table = table.join(_scanned(objects, features, pops, {}, by, [0.5] if ordered else [], spread, True), "g", "left")
    else:
        table = table.withColumns({"stats": F.lit(None).cast("array<struct<n: bigint>>"), "found": F.lit(None).cast("map<int, struct<mad: double>>")})
    size = {p: F.coalesce(F.get("sizes", F.lit(i)), F.lit(0)) for i, p in enumerate(counted)}
    place = {(p, f): i * len(features) + j for i, p in enumerate(pops) for j, f in enumerate(features)}
    out = []
    for r in rows:
        v = _value(r, cat, size, place)
        v = F.lit(None).cast("double") if v is None else v.cast("double")
        out.append(F.struct(F.lit(r.name).alias("name"), F.when(F.abs(v) < 1e308, v).otherwise(F.lit(NAN)).alias("value")))
    return _listed(table if by else _one_row(table), by, out)


def _value(r: ReportRow, cat, size: dict[str, Column], place: dict[tuple[str, str], int]) -> Column | None:
    """The statistic from a row of sizes, stats and order statistics; None or null if it has none."""
    p, q, kind = r.population, r.population2, r.statistic
    share = lambda a, b: F.when(b > 0, 100.0 * a / b)
    if kind in ("Objects/mL", "Mode") or p not in size or p not in cat.pops:
        return F.lit(0.0) if kind == "NaN" and p not in cat.pops else None
    if kind == "Count":
        return size[p]
    if kind == "%Total":
        return share(size[p], size[ALL])
    if kind == "%Gated":
        return share(size[p], size[cat.pops[p].base]) if cat.pops[p].base in size else None
    if kind == "%":
        return share(size[p], size[q]) if q in size else None
    if (p, r.feature) not in place:
        return F.lit(0.0) if kind == "NaN" else None
    stats = {x: F.get("stats", F.lit(place[x, r.feature])) for x in (p, q) if (x, r.feature) in place}
    found = {x: F.element_at("found", F.lit(place[x, r.feature])) for x in stats}
    a, b = stats[p], stats.get(q)
    if kind == "NaN":
        return F.when((a["n"] > 0) & (size[ALL] > a["n_bad"]), a["n_bad"])
    some = a["n"] + a["n_inf"] > 0
    if kind == "RD - Median":
        if q not in found:
            return None
        spread = MAD_SCALE * (found[p]["mad"] + found[q]["mad"])
        return F.when(some & (spread > 0), F.abs(F.get(found[p]["q"], F.lit(0)) - F.get(found[q]["q"], F.lit(0))) / spread)
    if kind in ORDERED:
        return F.when(some, F.get(found[p]["q"], F.lit(0)) if kind == "Median" else MAD_SCALE * found[p]["mad"])
    if kind == "geomean":
        return F.when(some, a["geomean"])
    if kind in ("min", "max"):
        return F.when(a["n"] > 0, a["least" if kind == "min" else "most"])
    sd, whole = F.sqrt(a["var"]), (a["n"] > 0) & (a["n_inf"] == 0)
    if kind == "RD - Mean":
        if b is None:
            return None
        spread = sd + F.sqrt(b["var"])
        return F.when(whole & (b["n"] > 0) & (b["n_inf"] == 0) & (spread > 0), F.abs(a["mean"] - b["mean"]) / spread)
    return F.when(whole, {"Mean": a["mean"], "CV": F.when(a["mean"] != 0, 100 * sd / a["mean"]), "stddev": sd, "Variance": a["var"]}[kind])
