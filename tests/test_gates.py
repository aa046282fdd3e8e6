"""Gates, transforms and expressions against independent forms."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatewise.functions import expressions, transforms
from gatewise.functions.numbers import INF, NAN
from gatewise.operators import gates
from gatewise.operators.gates import Region, expand, gate, sync_problems

POINTS = [(x / 2, y / 2) for x in range(-2, 11) for y in range(-2, 11)] + [(NAN, 1.0), (1.0, NAN), (INF, 1.0), (1.0, -INF), (None, 1.0), (1.0, None)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(POINTS)], "k int, x double, y double").cache()


def inside(points, region, **kw):
    got = points.select("k", gate(region, F.col("x"), F.col("y"), **kw).alias("in")).collect()
    assert all(r["in"] is not None for r in got)
    return {r["k"] for r in got if r["in"]}


def want(test):
    ok = lambda p: None not in p and not any(map(math.isnan, p))
    return {i for i, p in enumerate(POINTS) if ok(p) and test(*p)}


def test_line_and_rect(points):
    line = points.select("k", gate(Region("l", "line", (3.0, 1.0)), F.col("x")).alias("in")).filter("in")
    assert {r["k"] for r in line.collect()} == {i for i, (x, _) in enumerate(POINTS) if x is not None and 1 <= x <= 3}
    assert inside(points, Region("r", "rect", (3.0, 1.0), (0.0, 2.0))) == want(lambda x, y: 1 <= x <= 3 and 0 <= y <= 2)
    assert inside(points, Region("r", "rect", (-INF, INF), (0.0, INF))) == want(lambda x, y: y >= 0)


def test_dual_and_quad_split_the_plane(points):
    for kind, region in (("dual", Region("d", "line", (2.0, 9.0))), ("quad", Region("q", "rect", (2.0, 9.0), (1.5, 9.0)))):
        parts = [inside(points, r) for r in expand(region, kind)]
        finite = want(lambda x, y: math.isfinite(x) and math.isfinite(y))
        assert set().union(*parts) >= finite
        assert sum(len(p & finite) for p in parts) == len(finite)
    upper_left = inside(points, expand(Region("q", "rect", (2.0, 9.0), (1.5, 9.0)), "quad")[0])
    assert upper_left == want(lambda x, y: x < 2 and 1.5 <= y < INF)


def test_oval(points):
    test = lambda x, y: ((x - 2) / 2) ** 2 + ((y - 3) / 1.5) ** 2 <= 1
    assert inside(points, Region("o", "oval", (0.0, 4.0), (1.5, 4.5))) == want(lambda x, y: math.isfinite(x) and math.isfinite(y) and test(x, y))
    assert inside(points, Region("o", "oval", (1.0, 1.0), (0.0, 2.0))) == set()


def winding(x, y, xs, ys):
    total = 0.0
    for x1, y1, x2, y2 in zip(xs, ys, [*xs[1:], xs[0]], [*ys[1:], ys[0]]):
        a, b = (x1 - x, y1 - y), (x2 - x, y2 - y)
        cross, dot = a[0] * b[1] - a[1] * b[0], a[0] * b[0] + a[1] * b[1]
        if cross == 0 and dot <= 0:
            return True  # on the edge
        total += math.atan2(cross, dot)
    return abs(total) >= math.pi


SHAPES = {
    "concave": ((0.0, 4.0, 4.0, 2.0, 0.0), (0.0, 0.0, 4.0, 2.0, 4.0)),
    "star": ((0.5, 2.0, 3.5, 0.0, 4.0), (0.0, 4.0, 0.0, 2.5, 2.5)),
    "line": ((1.0, 3.0), (1.0, 3.0)),
    "dot": ((1.0,), (1.0,)),
    "circle": (tuple(2.1 + 2 * math.cos(k / 20 * math.tau) for k in range(20)), tuple(2.03 + 2 * math.sin(k / 20 * math.tau) for k in range(20))),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("unrolled", [100, 0])
def test_polygon(points, name, unrolled):
    xs, ys = SHAPES[name]
    test = lambda x, y: math.isfinite(x) and math.isfinite(y) and (winding(x, y, xs, ys) if len(xs) > 1 else (x, y) == (1, 1))
    assert inside(points, Region("p", "poly", xs, ys), unrolled=unrolled) == want(test)


def test_random_points_in_a_pentagram(spark):
    rng = np.random.default_rng(5)
    pts = rng.uniform(-1, 5, (5000, 2))
    xs, ys = SHAPES["star"]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k int, x double, y double")
    for unrolled in (100, 0):
        got = {r["k"] for r in df.filter(gate(Region("p", "poly", xs, ys), F.col("x"), F.col("y"), unrolled=unrolled)).collect()}
        assert got == {i for i, (x, y) in enumerate(pts) if winding(x, y, xs, ys)}


def test_region_errors():
    for bad in (dict(type="blob"), dict(x=(1.0,)), dict(x=(NAN, 1.0)), dict(y=(1.0,)), dict(label=""), dict(xtrans="what|1")):
        with pytest.raises(ValueError):
            Region(**{"label": "r", "type": "rect", "x": (0.0, 1.0), "y": (0.0, 1.0)} | bad)
    parts = expand(Region("q", "rect", (0.0, 1.0), (0.0, 1.0)), "quad")
    assert not sync_problems(parts)
    assert sync_problems(parts[:3]) == {"quad_q": "parts are missing or repeated"}


SPECS = ("P", "1000", "50", "smoothAsinh|5", "asinh", "smoothLinLog|500|10|2")


@given(st.floats(-1e9, 1e9), st.sampled_from(SPECS))
def test_transforms_invert(x, spec):
    assert transforms.transform_value(transforms.transform_value(x, spec), spec, inverse=True) == pytest.approx(x, rel=1e-9, abs=1e-9)


def test_transform_columns_match_numbers(spark):
    values = [-1e6, -1000.0, -3.0, 0.0, 0.5, 1000.0, 1001.0, 1e7, INF, NAN]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for spec in (*SPECS, "sqrt", "pow2"):
        for inverse in (False, True):
            if (inverse and spec in ("asinh", "smoothAsinh|5")) or (spec == "pow2" and inverse):
                continue
            got = [r[0] for r in df.select(transforms.transform(F.col("x"), spec, inverse)).collect()]
            for v, g in zip(values[:-2], got):
                try:
                    w = transforms.transform_value(v, spec, inverse)
                except OverflowError:
                    continue
                assert (math.isnan(w) and math.isnan(g)) or g == pytest.approx(w, rel=1e-12)
            assert math.isnan(got[-1])


NAMES = {"a": 4.0, "b|c": 0.0, "And": -2.0, "n": NAN}


@pytest.mark.parametrize(
    "text,value",
    [
        ("a|+|2|*|3", 10.0), ("(|a|+|2|)|*|3", 18.0), ("SQRT|a|+|SQR|3", 11.0), ("ABS|And|-|a", -2.0), ("-|And", 2.0), ("a|/|b|c", NAN), ("1|/|(|1|/|b|c|)", 0.0),
        ("SQRT|And", NAN), ("n|*|b|c", NAN), ("a|-|1|-|1", 2.0), ("8|/|a|/|2", 1.0), ("COS|b|c|+|SIN|b|c", 1.0),
    ],
)
def test_feature_expressions(spark, text, value):
    cols = {k: F.lit(v) for k, v in NAMES.items()}
    got = spark.range(1).select(expressions.feature(text, cols)).first()[0]
    assert (math.isnan(got) and math.isnan(value)) or got == pytest.approx(value)


@pytest.mark.parametrize("text", ["a|+", "(|a", "a|)", "zzz", "a|a", "", "*|a"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        expressions.feature(text, {"a": F.lit(1.0)})


def test_boolean_precedence(spark):
    rows = spark.createDataFrame([(p, q, r) for p in (True, False) for q in (True, False) for r in (True, False)], "p boolean, q boolean, r boolean")
    cols = {"p": F.col("p"), "q And": F.col("q"), "r": F.col("r")}
    for text, test in (
        ("p|Or|q And|And|Not|r", lambda p, q, r: p or (q and not r)),
        ("Not|(|p|Or|q And|)|And|r", lambda p, q, r: not (p or q) and r),
        ("Not|Not|p", lambda p, q, r: p),
    ):
        got = rows.select("p", "q", "r", expressions.boolean(text, cols).alias("v")).collect()
        assert all(x["v"] == test(x["p"], x["q"], x["r"]) for x in got)


def test_limits_and_clips():
    assert gates.limits() == (-math.inf, math.inf) and gates.limits([3.0, math.nan, -1.0]) == (-1.0, 3.0)
    assert gates.clipped([-math.inf, 1.0, 2.0, math.inf]) == [1.0, 2.0] and gates.clipped([0.0, 1.0, 2.0], [2.0, 0.0]) == [1.0]
    assert gates.clipped([1.0], [math.nan]) == []


@pytest.mark.parametrize("unrolled", [100, 0])
def test_sides_by_winding_number(points, unrolled):
    """Without an epsilon polygons side by side share no points and leave none out."""
    left, right = Region("l", "poly", (0.0, 2.0, 1.0, 0.0), (0.0, 0.0, 4.0, 4.0)), Region("r", "poly", (2.0, 4.0, 4.0, 1.0), (0.0, 0.0, 4.0, 4.0))
    a, b = (inside(points, r, eps=None, unrolled=unrolled) for r in (left, right))
    both = want(lambda x, y: 0 <= x < 4 and 0 <= y < 4)
    assert not a & b and a | b == both
    assert inside(points, left) & inside(points, right)


def test_polygon_query_on_points_of_its_sides(spark, tmp_path):
    """Prices on the sides of the concave polygon, and a cent before and after them."""
    from oracle import compare, connection

    from gatewise.plans import gating, registry

    rows, at = [], list(zip(gating.CONCAVE.x, gating.CONCAVE.y))
    for (x1, y1), (x2, y2) in zip(at, at[1:] + at[:1]):
        for k in range(11):
            on = x1 + (k / 100 - y1) * (x2 - x1) / (y2 - y1) if y1 != y2 else 5000.0
            rows += [(len(rows) + i, 1, round(on + c, 2), k / 100, f"{len(rows) + i}") for i, c in enumerate((-0.01, 0.0, 0.01))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string")
    df = df.selectExpr("*", "1D AS l_quantity", "0D AS l_tax")
    df.toPandas().to_parquet(tmp_path / "lineitem.parquet")
    name = "gate_poly_concave"
    mine, theirs = compare(registry.QUERIES[name](spark, str(tmp_path)), connection(tmp_path), registry.ORACLES[name])
    assert mine == theirs and len(mine[1]) > 30
