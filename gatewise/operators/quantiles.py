"""Exact order statistics of many columns in groups of any size, in two scans.

A first scan keeps a sketch of each column (among other aggregates); its error
bound gives, for each wanted rank, bounds that its value lies between, and, for
the median of absolute deviations, the two zones around the median in which the
values at that distance lie. The second scan counts what lies below the bounds and
lets only the few values strictly between them through. These are ranked bin by
bin, so nothing is gathered in one task, or on the driver if they are FEW at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved

#: Ranks of the sketch are right within 1 / ACCURACY of the rows (and one row); GRID of
#: them are kept.
ACCURACY = 10_000
GRID = 256
MARGIN = 3 / ACCURACY
#: Rows of counts and of values between bounds that the driver may finish; more stay distributed.
FEW = 1 << 16
#: Bins in which the values between two bounds are ranked.
BINS = 1024


def probabilities(probs: Sequence[float]) -> list[float]:
    """The shares at which the sketch is read: a grid, and just around ``probs``."""
    around = [p + s * MARGIN for p in probs for s in (-2, 2)]
    return sorted({*(i / GRID for i in range(GRID + 1)), *(p for p in around if 0 < p < 1)})


def sketch(value: Column, probs: Sequence[float]) -> Column:
    """An aggregate: approximate quantiles of the non-null values (null if there are none)."""
    return F.percentile_approx(value, F.array(*(F.lit(float(p)) for p in probabilities(probs))), F.lit(ACCURACY))


def quantile_ranks(n: int, probs: Sequence[float]) -> list[tuple[int, int]]:
    """0-based ranks between which each quantile lies (linear interpolation)."""
    return [(r, min(r + 1, n - 1)) for r in (math.floor((n - 1) * p) for p in probs)]


def bounds(at: np.ndarray, shares: np.ndarray, n: int, probs: Sequence[float], margin: float) -> list[tuple[float, float]]:
    """Values that hold the ranks of each quantile of ``n`` values between them."""
    out = []
    for r0, r1 in quantile_ranks(n, probs):
        low = np.searchsorted(shares, (r0 - 1) / n - margin, side="right") - 1
        high = np.searchsorted(shares, (r1 + 2) / n + margin, side="left")
        out.append((float(at[max(low, 0)]), float(at[min(high, len(at) - 1)])))
    return out


def zones(at: np.ndarray, shares: np.ndarray, n: int, middle: tuple[float, float], margin: float) -> tuple[float, float, float, float]:
    """a <= b <= c <= d: whatever the median in ``middle`` is, values between b and c
    are nearer to it than the median distance, and those under a or over d farther."""
    (r0, r1), (lo, hi) = quantile_ranks(n, [0.5])[0], middle

    def most(x: np.ndarray) -> np.ndarray:  # share of values that x or less have, at most
        i = np.searchsorted(at, x, side="right")
        return np.where(i < len(at), shares[np.minimum(i, len(at) - 1)] + margin + 1 / n, 1.0)

    def least(x: np.ndarray) -> np.ndarray:  # at least
        i = np.searchsorted(at, x, side="right") - 1
        return np.where(i >= 0, shares[np.maximum(i, 0)] - margin - 1 / n, 0.0)

    with np.errstate(over="ignore", invalid="ignore"):
        far = np.unique(np.abs(np.concatenate([at - lo, at - hi])))
        inside = (most(hi + far) - least(np.nextafter(lo - far, -np.inf))) * n <= r0
        enough = (least(lo + far) - most(np.nextafter(hi - far, -np.inf))) * n >= r1 + 1
        near = far[inside].max() if inside.any() else -1.0
        away = far[enough].min() if enough.any() else math.inf
        a, d = max(lo - away, float(at[0])), min(hi + away, float(at[-1]))
        b, c = hi - near, lo + near
    # One zone if nothing is surely nearer; no value is in the other.
    return (a, b, c, d) if near >= 0 and a <= b < c <= d else (a, d, -math.inf, -math.inf)


def _plan(probs: Sequence[float], spread: bool, margin: float):
    shares = np.array(probabilities(probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts, sketches in zip(batch.column("counts").to_pylist(), batch.column("sketches").to_pylist()):
                row = []
                for n, at in zip(counts, sketches):
                    if not n or at is None:
                        row.append([math.nan] * (2 * len(probs) + 4 * spread))
                        continue
                    at = np.array(at)
                    ends = [x for b in bounds(at, shares, n, probs, margin) for x in b]
                    row.append(ends + list(zones(at, shares, n, bounds(at, shares, n, [0.5], margin)[0], margin)) * spread)
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["g", "ends"])

    return run


def _ranked(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, second: the values at ranks r0 and r1 of ``wanted`` (keys, below: the
    number of values before all, r0, r1, lo, hi) among ``values`` (keys, v, n: how often)."""
    width = F.col("hi") / 2 - F.col("lo") / 2  # halves keep the widest ranges finite
    place = F.when(width > 0, F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS)).otherwise(0)
    binned = values.join(wanted, keys).withColumn("bin", F.greatest(F.lit(0), F.least(place, F.lit(BINS - 1))).cast("int"))
    names = ["below", "r0", "r1"]
    bins = binned.groupBy(*keys, *names, "bin").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    bins = bins.withColumn("ahead", F.col("below") + F.coalesce(F.sum("m").over(before), F.lit(0)))
    end = F.col("ahead") + F.col("m")
    bins = bins.filter(((F.col("ahead") <= F.col("r0")) & (F.col("r0") < end)) | ((F.col("ahead") <= F.col("r1")) & (F.col("r1") < end))).select(*keys, "bin", "ahead")
    few = binned.join(bins, [*keys, "bin"]).groupBy(*keys, *names[1:], "bin", "ahead", "v").agg(F.sum("n").alias("n"))
    till = Window.partitionBy(*keys, "bin").orderBy("v")
    few = few.withColumn("till", F.col("ahead") + F.sum("n").over(till))
    at = [F.min(F.when((F.col("ahead") <= F.col(r)) & (F.col("till") > F.col(r)), F.col("v"))).alias(c) for r, c in (("r0", "first"), ("r1", "second"))]
    return few.groupBy(*keys).agg(*at)


def _passed(rows: DataFrame, first: DataFrame, values: Sequence[str], probs: Sequence[float], spread: bool, margin: float) -> tuple[DataFrame, DataFrame]:
    """The second scan. plan: g and the bounds of each column; passed: g, k, slot, v, n, the
    number of values by slot, and of each between two bounds.

    Columns become rows, so the code that Spark makes stays small however many there
    are. A value's slot is twice the number of bounds below it, and one for each that it
    equals: values in one slot compare alike with every bound."""
    n_b = 2 * (len(probs) + 2 * spread)
    plan = saved(first.mapInArrow(_plan(probs, spread, margin), f"g {first.schema['g'].dataType.simpleString()}, ends array<array<double>>"), "bounds")
    ends_of = plan.select("g", F.posexplode("ends").alias("k", "ends")).select("g", "k", *(F.get("ends", F.lit(i)).alias(f"b{i}") for i in range(n_b)))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in enumerate(values)))
    at = rows.select("g", F.inline(each)).filter("v is not null").join(ends_of, ["g", "k"])
    v, ends = F.col("v"), [F.col(f"b{i}") for i in range(n_b)]
    one = lambda hit: F.when(hit, 1).otherwise(0)
    slot = reduce(add, [one(b < v) + one(b <= v) for b in ends])
    hit = reduce(or_, [(lo < v) & (v < hi) for lo, hi in zip(ends[::2], ends[1::2])])
    # Values between no bounds are one group a slot, counted before the shuffle.
    passed = saved(at.select("g", "k", slot.alias("slot"), F.when(hit, v).alias("v")).groupBy("g", "k", "slot", "v").agg(F.count("*").alias("n")), "between")
    return plan, passed


def _finished(plan: DataFrame, passed: DataFrame, first: DataFrame, probs: Sequence[float], spread: bool) -> list[tuple] | None:
    """(g, k, quantiles, mad) from few rows of ``_passed``; None if a sketch broke its promise."""
    table = passed.toArrow()
    ends = {tuple(r["g"]): r["ends"] for r in plan.collect()}
    counts = {tuple(r["g"]): r["counts"] for r in first.select("g", "counts").collect()}
    found: dict[tuple, list] = {}
    for g, *row in zip(*(table.column(c).to_pylist() for c in ("g", "k", "slot", "v", "n"))):
        found.setdefault((tuple(g.values()), row[0]), []).append(row[1:])
    out = []
    for (g, k), rows in found.items():
        at, n = np.array(ends[g][k]), counts[g][k]
        slot, v, m = (np.array(c, t) for c, t in zip(zip(*rows), (int, float, int)))
        mark = [int((at < x).sum() + (at <= x).sum()) for x in at]
        one = lambda z: (at[2 * z], at[2 * z + 1], mark[2 * z], mark[2 * z + 1])  # noqa: B023, E731

        def within(z: int) -> tuple[np.ndarray, np.ndarray]:
            lo, hi, low, high = one(z)  # noqa: B023
            tips = [(lo, m[slot == low].sum()), (hi, m[slot == high].sum() if high > low else 0)]  # noqa: B023
            open_ = (v > lo) & (v < hi)  # noqa: B023
            return np.append(v[open_], [x for x, c in tips if c]), np.append(m[open_], [c for _, c in tips if c])  # noqa: B023

        def at_ranks(x: np.ndarray, c: np.ndarray, below: int, ranks: tuple[int, int]) -> tuple[float, float] | None:
            order = np.argsort(x, kind="stable")
            till = below + np.cumsum(c[order])
            if not len(till) or below > ranks[0] or till[-1] <= ranks[1]:
                return None
            return tuple(float(x[order][np.searchsorted(till, r, side="right")]) for r in ranks)

        q = []
        for z, (p, ranks) in enumerate(zip(probs, quantile_ranks(n, probs))):
            pair = at_ranks(*within(z), int(m[slot < mark[2 * z]].sum()), ranks)
            if pair is None:
                return None
            part = (n - 1) * p - ranks[0]
            q.append(pair[0] if part == 0 else pair[0] + part * (pair[1] - pair[0]))
        mad = None
        if spread:
            z = len(probs)
            (x, c), (y, d) = within(z), within(z + 1)
            inner = int(m[(slot > mark[2 * z + 1]) & (slot < mark[2 * z + 2])].sum())
            pair = at_ranks(np.abs(np.append(x, y) - q[list(probs).index(0.5)]), np.append(c, d), inner, quantile_ranks(n, [0.5])[0])
            if pair is None:
                return None
            mad = pair[0] if n % 2 else pair[0] / 2 + pair[1] / 2
        out.append((g, k, q, mad))
    return out


def _spans(plan: DataFrame, passed: DataFrame, first: DataFrame, probs: Sequence[float], spread: bool) -> tuple[DataFrame, DataFrame]:
    """spans: g, k, z, count, lo, hi, and how many values are below, between the zones
    (inner) and within; known: g, k, z, v, n of the values within."""
    n_z, keys = len(probs) + 2 * spread, ["g", "k", "z"]
    n_b = 2 * n_z
    one = lambda hit: F.when(hit, 1).otherwise(0)
    slots = passed.groupBy("g", "k", "slot").agg(F.sum("n").alias("n")).groupBy("g", "k").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    bounded = plan.join(first.select("g", "counts"), "g").select("g", F.posexplode("ends").alias("k", "ends"), "counts")
    bounded = bounded.join(slots, ["g", "k"]).withColumn("count", F.get("counts", F.col("k")))
    mark = F.transform("ends", lambda x: F.aggregate("ends", F.lit(0), lambda n, e: n + one(e < x) + one(e <= x)))
    bounded = bounded.withColumn("mark", mark)

    def number(test) -> Column:
        return F.aggregate(F.filter("slots", test), F.lit(0).cast("long"), lambda n, s: n + s["n"])

    def spot(z: int) -> Column:
        lo, hi = (F.get("mark", F.lit(2 * z + i)) for i in (0, 1))
        inner = number(lambda s: (s["slot"] > F.get("mark", F.lit(n_b - 3))) & (s["slot"] < F.get("mark", F.lit(n_b - 2)))) if spread else F.lit(0).cast("long")
        at_hi = F.when(hi > lo, number(lambda s: s["slot"] == hi)).otherwise(0)
        lohi = (F.get("ends", F.lit(2 * z + i)) for i in (0, 1))
        return F.struct(F.lit(z).alias("z"), *(c.alias(n) for n, c in zip(("lo", "hi", "below", "at_lo", "at_hi", "inner"), (*lohi, number(lambda s: s["slot"] < lo), number(lambda s: s["slot"] == lo), at_hi, inner))))

    spans = saved(bounded.filter("count > 0").select("g", "k", "count", F.inline(F.array(*(spot(z) for z in range(n_z))))), "spots")
    tips = spans.select(*keys, F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("at_lo").alias("n")), F.struct(F.col("hi").alias("v"), F.col("at_hi").alias("n"))))).filter("n > 0")
    between = passed.filter("v is not null").join(spans.select(*keys, "lo", "hi"), ["g", "k"]).filter("lo < v and v < hi").select(*keys, "v", "n")
    known = saved(tips.unionByName(between), "known")
    within = known.groupBy(*keys).agg(F.sum("n").alias("within"))
    return spans.join(within, keys, "left").withColumn("within", F.coalesce("within", F.lit(0))), known


def order_statistics(rows: DataFrame, first: DataFrame, values: Sequence[str], probs: Sequence[float], spread: bool = False) -> DataFrame:
    """g, found: for each group a map from the number of a column to its quantiles
    (``q``, as ``probs``) and, with ``spread`` (``probs`` has 0.5), the ``mad`` (median
    of absolute deviations).

    ``rows``: g (a struct) and the columns ``values`` (double; nulls don't count).
    ``first``: g, counts, sketches: the number of values and the ``sketch`` of each
    column, a table from a first scan of the same rows. Columns without values are
    left out. The rows are scanned once; again only if a sketch breaks its promise.
    """
    n_q, keys, margin = len(probs), ["g", "k", "z"], MARGIN
    wanted = F.col("z") < n_q
    h = (F.col("count") - 1) * F.when(wanted, F.get(F.array(*(F.lit(float(p)) for p in probs)), F.col("z"))).otherwise(F.lit(0.5))
    while True:
        plan, passed = _passed(rows, first, values, probs, spread, margin)
        if passed.limit(FEW + 1).count() <= FEW:
            done = _finished(plan, passed, first, probs, spread)
            if done is None and margin < 1:
                margin *= 16
                continue
            g = first.schema["g"].dataType.simpleString()
            each = rows.sparkSession.createDataFrame(done or [], f"g {g}, k int, q array<double>, mad double")
            return each.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("q", "mad")))).alias("found"))
        spans, known = _spans(plan, passed, first, probs, spread)
        spans = saved(spans, "spans")
        spans = spans.withColumn("h", h).withColumn("r0", F.floor("h")).withColumn("r1", F.least(F.col("r0") + 1, F.col("count") - 1))
        zones_ = spans.filter(~wanted).groupBy("g", "k").agg(F.max("inner").alias("below"), F.max("r0").alias("r0"), F.max("r1").alias("r1"), F.sum("within").alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        zones_ = zones_.withColumns({"lo": F.least("lo", "hi"), "hi": F.greatest("lo", "hi")})
        off = lambda df: df.filter((F.col("below") > F.col("r0")) | (F.col("below") + F.col("within") <= F.col("r1")))
        if margin >= 1 or (off(spans.filter(wanted)).isEmpty() and off(zones_).isEmpty()):
            break
        margin *= 16
    ranked = _ranked(known, spans.filter(wanted).select(*keys, "below", "r0", "r1", "lo", "hi"), keys)
    part = F.col("h") - F.col("r0")
    value = F.when(part == 0, F.col("first")).otherwise(F.col("first") + part * (F.col("second") - F.col("first")))
    quantile = spans.filter(wanted).join(ranked, keys).select("g", "k", "z", value.alias("v"))
    each = quantile.groupBy("g", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "v"))), lambda s: s["v"]).alias("q"))
    if spread:
        each = saved(each, "quantiles")
        middle = each.select("g", "k", F.get("q", F.lit(list(probs).index(0.5))).alias("m"))
        away = known.filter(~wanted).join(middle, ["g", "k"]).select("g", "k", F.abs(F.col("v") - F.col("m")).alias("v"), "n")
        # Zones that lie at -inf are empty.
        most = F.greatest(F.when(F.col("lo") > -math.inf, F.abs(F.col("lo") - F.col("m"))), F.abs(F.col("hi") - F.col("m")))
        zone = zones_.join(middle, ["g", "k"]).select("g", "k", "below", "r0", "r1", F.lit(0.0).alias("lo"), most.alias("hi"))
        mads = _ranked(away, zone, ["g", "k"])
        count = first.select("g", F.posexplode("counts").alias("k", "count"))
        mads = mads.join(count, ["g", "k"]).select("g", "k", F.when(F.col("count") % 2 == 1, F.col("first")).otherwise(F.col("first") / 2 + F.col("second") / 2).alias("mad"))
        each = each.join(mads, ["g", "k"], "left")
    else:
        each = each.withColumn("mad", F.lit(None).cast("double"))
    return each.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("q", "mad")))).alias("found"))
