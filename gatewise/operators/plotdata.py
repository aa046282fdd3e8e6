"""Data behind plots: viewports, histograms, density and pixel bins, region and
population summaries, layouts. Only bins leave the cluster, never points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import finite, is_finite
from ..functions.transforms import transform, transform_value
from .catalog import ALL, Graph
from .gates import Region, gate
from .populations import Objects, first_hashed, member, named

HISTOGRAM_BINS, DENSITY_BINS = 520, 128
MARGIN = 0.07


def plot_rows(objects: Objects, graph: Graph, keep: Sequence[str] = ()) -> DataFrame:
    """Columns id (and file), x1, x2 (y1, y2): raw and transformed coordinates of
    the rows in any base population, with memberships of the shown ones."""
    pops = list(dict.fromkeys([*graph.base, *graph.shown]))
    axes = [graph.f1] + ([graph.f2] if graph.f2 else [])
    df = objects.members(pops, keep=[*axes, *keep])
    df = df.filter(reduce(lambda a, b: a | b, map(member, graph.base)))
    cols = [named(c) for c in (objects.file_col, objects.id_col) if c]
    for n, a, t in zip("xy", axes, (graph.xtrans, graph.ytrans)):
        v = named(a).cast("double")
        cols += [v.alias(f"{n}1"), transform(v, t).alias(f"{n}2")]
    return df.select(*cols, *(member(p) for p in pops), *(named(k) for k in keep))


def sample_points(rows: DataFrame, id_cols: Sequence[str], most: float, seed: int = 1) -> DataFrame:
    """At most ``most`` rows (a fraction if 1 or less), the first of a hashed order."""
    size = math.floor(most * rows.count()) if most <= 1 else int(most)
    keys = [named(c) for c in id_cols]
    return first_hashed(rows, F.xxhash64(*keys, F.lit(seed)), keys, size)


def widened(lo: float, hi: float) -> tuple[float, float]:
    lo, hi = lo - MARGIN * (hi - lo), hi + MARGIN * (hi - lo)
    return (lo - MARGIN, lo + MARGIN) if lo == hi else (lo, hi)


def viewport(rows: DataFrame, graph: Graph, kind: str = "data", regions: Sequence[Region] = ()) -> dict[str, tuple[float, float]]:
    """Limits of each axis in transformed space: of the finite ``data``, of data and
    region vertices (``max``), or as given in the graph (``given``)."""
    axes = [("x", graph.xtrans)] + ([("y", graph.ytrans)] if graph.f2 else [])
    found = rows.agg(*(f(finite(F.col(f"{a}1"))).alias(f"{a}{n}") for a, _ in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for i, (a, t) in enumerate(axes):
        at = [found[f"{a}lo"], found[f"{a}hi"]]
        if kind == "max":
            at += [v for r in regions for v in (r.x if a == "x" else r.y)]
        at = [v for v in at if v is not None and math.isfinite(v)]
        if kind == "given" or not at:
            if graph.limits is None:
                at = [-1.0, 1.0]
            else:
                at = list(graph.limits[2 * i : 2 * i + 2])
            lo, hi = transform_value(min(at), t), transform_value(max(at), t)
            out[a] = (lo, hi) if lo < hi else widened(lo, hi)
        else:
            out[a] = widened(transform_value(min(at), t), transform_value(max(at), t))
    return out


def right_closed(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based bin of lo..hi with right ends in (and the lowest bound); null outside."""
    at = F.greatest(F.lit(1), F.ceil((x - lo) / ((hi - lo) / bins))).cast("long")
    return F.when(is_finite(x) & (x >= lo) & (x <= hi), F.least(at, F.lit(bins)))


def clamped(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def histogram(rows: DataFrame, x: Column, lo: float, hi: float, bins: int = HISTOGRAM_BINS, clamp: bool = False) -> DataFrame:
    """bin, count, percent (of all rows) for bins that hold a value; with ``clamp``
    values beyond the limits count at the limits."""
    v = clamped(x, lo, hi) if clamp else x
    counts = rows.select(right_closed(v, lo, hi, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # a row per bin
    return counts.select("bin", "count", (100.0 * F.col("count") / total).alias("percent")).filter("bin is not null")


def heights(counts: Sequence[int], lo: float, hi: float, kind: str = "count", total: int | None = None) -> list[float]:
    """Bar heights: count, percent or density; or mids and breaks of the bins."""
    n, width = len(counts), (hi - lo) / len(counts)
    every = sum(counts) if total is None else total
    return {
        "count": lambda: [float(c) for c in counts],
        "percent": lambda: [100.0 * c / every for c in counts],
        "density": lambda: [c / (sum(counts) * width) for c in counts],
        "mids": lambda: [lo + width * (i + 0.5) for i in range(n)],
        "breaks": lambda: [lo + width * i for i in range(n + 1)],
    }[kind]()


def height_range(counts: Sequence[int], lo: float, hi: float, kind: str = "count", total: int | None = None) -> tuple[float, float]:
    """Limits of the height axis: of 0 and all bars."""
    values = [0.0, *heights(counts, lo, hi, kind, total)]
    return min(values), max(values)


def smoothed(counts: Sequence[int], lo: float, hi: float, factor: float = 1.0, scale: str = "mass", most: float = 1.0) -> np.ndarray:
    """A Gaussian density through histogram counts.

    The kernel is integrated over each bin, so counts keep their ``mass`` (but for
    what goes beyond the limits); with ``scale`` "most" the curve is 0 outside the
    filled bins and its top is ``most`` (1, or the height of the highest bar).
    """
    n = np.asarray(counts, float)
    edges = np.arange(len(n) + 1)
    mids = edges[:-1] + 0.5
    total = max(n.sum(), 1.0)
    mean = (n * mids).sum() / total
    sd = math.sqrt(max((n * (mids - mean) ** 2).sum() / total, 1e-12))
    width = max(0.9 * sd * total**-0.2 * factor, 0.5)  # half a bin at least
    below = np.vectorize(math.erf, otypes=[float])((edges[:, None] - mids[None, :]) / (width * math.sqrt(2))) / 2
    out = np.diff(below, axis=0) @ n
    if scale == "mass":
        return out
    filled = np.flatnonzero(n)
    if not len(filled):
        return np.zeros(len(n))
    out[: filled[0]] = out[filled[-1] + 1 :] = 0.0
    return out / out.max() * most


def density_bins(rows: DataFrame, x: Column, y: Column, xlim: tuple[float, float], ylim: tuple[float, float], bins: int = DENSITY_BINS) -> DataFrame:
    """xbin, ybin, count, level (asinh of the count over the largest) of points
    inside the limits."""
    bx, by = right_closed(x, *xlim, bins).alias("xbin"), right_closed(y, *ylim, bins).alias("ybin")
    counts = rows.select(bx, by).filter("xbin is not null and ybin is not null").groupBy("xbin", "ybin").agg(F.count("*").alias("count"))
    most = F.max("count").over(Window.partitionBy())  # at most bins * bins rows
    return counts.select("xbin", "ybin", "count", (F.asinh(F.col("count") / most) / math.asinh(1)).alias("level"))


def point_density(rows: DataFrame, x: Column, y: Column, xlim: tuple[float, float], ylim: tuple[float, float], bins: int = DENSITY_BINS) -> DataFrame:
    """``rows`` with the level of the density bin each lies in (0 outside)."""
    table = density_bins(rows, x, y, xlim, ylim, bins).select("xbin", "ybin", "level")
    out = rows.withColumn("xbin", right_closed(x, *xlim, bins)).withColumn("ybin", right_closed(y, *ylim, bins))
    out = out.join(F.broadcast(table), ["xbin", "ybin"], "left")  # at most bins * bins rows
    return out.withColumn("level", F.coalesce("level", F.lit(0.0))).drop("xbin", "ybin")


def feature_level(rows: DataFrame, feature: str) -> DataFrame:
    """``rows`` with a feature scaled to 0..1 over its finite range."""
    v = named(feature).cast("double")
    ends = rows.agg(F.min(finite(v)).alias("_lo"), F.max(finite(v)).alias("_hi"))
    out = rows.join(F.broadcast(ends))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return out.withColumn("level", F.coalesce(finite((v - F.col("_lo")) / width), F.lit(0.0))).drop("_lo", "_hi")


@dataclass(frozen=True)
class CoordMap:
    """User limits and the pixel rectangle they are drawn in (y grows downwards)."""

    xlim: tuple[float, float]
    ylim: tuple[float, float]
    width: int
    height: int
    left: float = 0.0
    top: float = 0.0

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        sx = self.width / (self.xlim[1] - self.xlim[0])
        sy = self.height / (self.ylim[1] - self.ylim[0])
        return (x - self.xlim[0]) * sx + self.left, self.top + self.height - (y - self.ylim[0]) * sy


def pixel_bins(rows: DataFrame, x: Column, y: Column, at: CoordMap, edge: bool = False, first: Column | None = None) -> DataFrame:
    """px, py, count (and, given ``first``, the least of it: the point that is drawn).

    Points beyond the limits are left out or, with ``edge``, drawn at the border.
    """
    known = rows.filter(is_finite(x) & is_finite(y))
    if edge:
        x, y = clamped(x, *at.xlim), clamped(y, *at.ylim)
    else:
        known = known.filter(x.between(*at.xlim) & y.between(*at.ylim))
    px, py = at.pixel(x, y)
    aggs = [F.count("*").alias("count")] + ([F.min(first).alias("first")] if first is not None else [])
    return known.groupBy(F.floor(px).cast("int").alias("px"), F.floor(py).cast("int").alias("py")).agg(*aggs)


def gaussian(size: int, sigma: float) -> np.ndarray:
    """A square kernel that sums to 1."""
    r = np.arange(size) - (size - 1) / 2
    g = np.exp(-(r[:, None] ** 2 + r[None, :] ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def density_image(bins: DataFrame, at: CoordMap, size: int = 9, sigma: float = 3.0, levels: int = 256) -> np.ndarray:
    """Colour index of each pixel: counts blurred, then asinh scaled. ``bins`` has
    at most a row per pixel."""
    h, w = int(at.top + at.height) + 1, int(at.left + at.width) + 1
    image = np.zeros((h, w))
    for r in bins.select("px", "py", "count").collect():
        if 0 <= r["py"] < h and 0 <= r["px"] < w:
            image[r["py"], r["px"]] += r["count"]
    k, pad = gaussian(size, sigma), size // 2
    wide = np.pad(image, ((pad, size - 1 - pad), (pad, size - 1 - pad)))
    blurred = sum(k[i, j] * wide[i : i + h, j : j + w] for i in range(size) for j in range(size))
    most = blurred.max()
    return np.floor((levels - 0.001) / math.asinh(1) * np.arcsinh(blurred / most)).astype(int) if most else np.zeros((h, w), int)


def region_stats(objects: Objects, graph: Graph, eps: float = 1e-12) -> DataFrame:
    """label, base, count, perc of each base population, of each region within it
    and of each shown population within it. Regions are tested on the plot's axes."""
    rows = plot_rows(objects, graph)
    cat = objects.catalog
    parts: list[tuple[str, str, Column]] = []
    for b in graph.base:
        parts.append((b, b, member(b)))
        parts += [(f"{b} & {r}", b, member(b) & gate(cat.regions[r], F.col("x1"), F.col("y1") if graph.f2 else None, eps)) for r in graph.regions]
        parts += [(f"{b} & {s}", b, member(b) & member(s)) for s in graph.shown]
    counted = rows.agg(*(F.count_if(c).alias(f"n{i}") for i, (_, _, c) in enumerate(parts)))
    place = {label: i for i, (label, _, _) in enumerate(parts)}
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(b).alias("base"), F.col(f"n{i}").alias("count"), F.col(f"n{place[b]}").alias("of")) for i, (label, b, _) in enumerate(parts)))
    return counted.select(F.inline(each)).select("label", "base", "count", F.when(F.col("of") > 0, 100.0 * F.col("count") / F.col("of")).alias("perc"))


def layout(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Grid cells of graphs by their location: rows by y, places within by x (1-based)."""
    row = F.dense_rank().over(Window.orderBy(y))  # graphs of one report, a few rows
    return df.withColumn("row", row).withColumn("column", F.row_number().over(Window.partitionBy("row").orderBy(x)))


def grid(n: int, columns: int | None = None, by_row: bool = True) -> list[tuple[int, int]]:
    """(row, column) of ``n`` graphs, 0-based, in ``columns`` (near square if not given)."""
    columns = columns or max(1, math.ceil(math.sqrt(n)))
    rows = math.ceil(n / columns)
    return [(i // columns, i % columns) if by_row else (i % rows, i // rows) for i in range(n)]


def sibling_graph(objects: Objects, pop: str) -> Graph:
    """A plot of a graphical population's base with the gates that share its axes."""
    cat = objects.catalog
    p = cat.pops[pop]
    if p.type != "G":
        return Graph("histogram", next(iter(cat.features)), base=(pop,))
    r = cat.regions[p.region]
    peers = [n for n in cat.siblings([pop], same_base=True)]
    return Graph("scatter" if p.fy else "histogram", p.fx, p.fy, base=(p.base or ALL,), regions=tuple(cat.pops[n].region for n in peers), shown=tuple(peers), xtrans=r.xtrans, ytrans=r.ytrans, title=p.base or ALL)


def auto_graph(objects: Objects, pops: Sequence[str] = (ALL,), x: str | None = None, y: str | None = None, kind: str | None = None) -> Graph:
    """A plot from populations and axes; axes come from the first gate if not given."""
    first = objects.catalog.pops[pops[0]]
    x = x or first.fx or next(iter(objects.catalog.features))
    y = y if y is not None else (first.fy if x == first.fx else "")
    return Graph(kind or ("density" if y and len(pops) == 1 else "scatter" if y else "histogram"), x, y or "", base=tuple(pops))


def network(objects: Objects) -> tuple[DataFrame, DataFrame]:
    """Nodes (population, count, percents, level) and edges (source, target) of the hierarchy."""
    from .stats import pop_stats

    spark = objects.df.sparkSession
    level = F.create_map(*(x for n, d in objects.catalog.levels().items() for x in (F.lit(n), F.lit(d))))
    nodes = pop_stats(objects).withColumn("level", F.element_at(level, F.col("population")))
    return nodes, spark.createDataFrame(objects.catalog.edges(), "source string, target string")
