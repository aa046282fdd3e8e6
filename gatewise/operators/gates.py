"""Regions and their predicates: line, half line, rectangle, quadrant, ellipse
and polygon gates as boolean columns.

A gate is false, never null, where a coordinate is null or NaN. Vertices are
literals of the plan, transformed once on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.transforms import parse, transform, transform_value

KINDS = ("line", "rect", "oval", "poly")
EPSILON = 1e-12
#: Polygons up to this many edges become plain expressions; longer ones fold over
#: a literal array, which keeps generated code small.
UNROLLED = 24
INF = math.inf


@dataclass(frozen=True)
class Region:
    """Vertices ``x``, ``y`` (two bounds but for polygons, infinities allowed).

    ``xtrans`` and ``ytrans`` name the space in which ellipses and polygons are
    tested. ``sync`` is ``kind_name|part`` for parts of a dual or quad group.
    """

    label: str
    type: str
    x: tuple[float, ...]
    y: tuple[float, ...] = ()
    xtrans: str = "P"
    ytrans: str = "P"
    sync: str = ""
    color: str = "White"
    lightcolor: str = "Black"

    def __post_init__(self):
        x, y = tuple(map(float, self.x)), tuple(map(float, self.y))
        if self.type == "line" and not y:
            y = (0.0,) * len(x)
        object.__setattr__(self, "x", x)
        object.__setattr__(self, "y", y)
        if self.type not in KINDS:
            raise ValueError(f"region {self.label!r}: unknown type {self.type!r}")
        if not self.label:
            raise ValueError("a region needs a label")
        if len(x) != len(y) or any(map(math.isnan, (*x, *y))):
            raise ValueError(f"region {self.label!r}: x and y need equally many numbers")
        if len(x) < 1 or (self.type != "poly" and len(x) != 2):
            raise ValueError(f"region {self.label!r}: {self.type} takes two vertices")
        parse(self.xtrans)
        parse(self.ytrans)

    @property
    def sync_kind(self) -> str:
        return self.sync.split("_", 1)[0] if self.sync else ""

    @property
    def sync_name(self) -> str:
        return self.sync.rpartition("|")[0]

    @property
    def sync_part(self) -> int:
        return int(self.sync.rpartition("|")[2]) if self.sync else 0


def half(x: float, part: int) -> tuple[float, float]:
    """Bounds of the lower (1) or upper (2) half line at ``x``."""
    return (-INF, x) if part == 1 else (x, INF)


def quarter(x: float, y: float, part: int) -> tuple[tuple[float, float], tuple[float, float]]:
    """Bounds of a quadrant at (x, y): 1 upper left, 2 upper right, 3 lower right, 4 lower left."""
    return half(x, 1 if part in (1, 4) else 2), half(y, 2 if part in (1, 2) else 1)


def expand(region: Region, kind: str, taken: Sequence[str] = ()) -> list[Region]:
    """The two (``dual``) or four (``quad``) parts of a region whose first vertex
    divides the plane, labelled ``label_1`` and so on under one group mark."""
    n, name = {"dual": 2, "quad": 4}[kind], f"{kind}_{region.label}"
    while name in taken:
        name += "'"
    base = "line" if kind == "dual" else "rect"
    return [replace(region, label=f"{region.label}_{k}", type=base, sync=f"{name}|{k}") for k in range(1, n + 1)]


def sync_problems(regions: Sequence[Region]) -> dict[str, str]:
    """Group mark and what is wrong with it, for dual and quad groups whose parts
    are incomplete, repeated, of another type or at different dividers."""
    out = {}
    groups: dict[str, list[Region]] = {}
    for r in regions:
        if r.sync:
            groups.setdefault(r.sync_name, []).append(r)
    for name, members in groups.items():
        kind = members[0].sync_kind
        n, base = {"dual": (2, "line"), "quad": (4, "rect")}.get(kind, (0, ""))
        parts = sorted(r.sync_part for r in members)
        if not n:
            out[name] = "unknown kind"
        elif any(r.type != base for r in members):
            out[name] = "wrong region type"
        elif parts != list(range(1, n + 1)):
            out[name] = "parts are missing or repeated"
        elif len({(r.x, r.y, r.xtrans, r.ytrans) for r in members}) > 1:
            out[name] = "parts disagree"
    return out


def _known(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) for c in cols))


def _between(v: Column, lo: float, hi: float, upper: bool = True) -> Column:
    """lo <= v <= hi, or < hi; infinite bounds that can't fail are left out."""
    low = v >= F.lit(lo) if lo > -INF else F.lit(True)
    high = (v <= F.lit(hi)) if upper else (v < F.lit(hi))
    return low & high if hi < INF or not upper else low


def _oval(x: Column, y: Column, bx: Sequence[float], by: Sequence[float]) -> Column:
    rx, ry = abs(bx[1] - bx[0]) / 2, abs(by[1] - by[0]) / 2
    cx, cy = (bx[0] + bx[1]) / 2, (by[0] + by[1]) / 2
    if rx == 0 or ry == 0:
        return F.lit(False)
    dx, dy = (x - cx) / rx, (y - cy) / ry
    return dx * dx + dy * dy <= 1


def edges(xs: Sequence[float], ys: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """x1, y1, x2, y2 of each side of the closed polygon; repeated points drop out."""
    pts = list(zip(xs, ys))
    if pts[0] != pts[-1]:
        pts.append(pts[0])
    found = [(*a, *b) for a, b in zip(pts, pts[1:]) if a != b]
    return found or [(*pts[0], *pts[0])]


def _apart(a: float, b: float) -> float:
    """a - b of vertices as they are written (0.025 - 0.105 is -0.08), rounded once."""
    return float(Decimal(repr(a)) - Decimal(repr(b))) if math.isfinite(a) and math.isfinite(b) else a - b


def _on_edge(x: Column, y: Column, e: Sequence, eps: float) -> Column:
    x1, y1, x2, y2 = e
    level = (y == y1) & (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2))
    upright = (x == x1) & (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))
    tx = (x - x1) / F.when(x2 != x1, x2 - x1)
    ty = (y - y1) / F.when(y2 != y1, y2 - y1)
    slanted = (F.abs(ty - tx) < eps) & (ty > 0) & (ty < 1)
    return F.when(y1 == y2, level).when(x1 == x2, upright).otherwise(slanted)


def _on_literal_edge(x: Column, y: Column, e: Sequence[float], eps: float) -> Column:
    x1, y1, x2, y2 = e
    if y1 == y2:
        return (y == y1) & (x >= min(x1, x2)) & (x <= max(x1, x2))
    if x1 == x2:
        return (x == x1) & (y >= min(y1, y2)) & (y <= max(y1, y2))
    ty = (y - y1) / (y2 - y1)
    return (F.abs(ty - (x - x1) / (x2 - x1)) < eps) & (ty > 0) & (ty < 1)


def _winds(x: Column, y: Column, e: Sequence) -> Column:
    """+1 or -1 where the edge passes the point's height with it on the left or right."""
    x1, y1, x2, y2, dx, dy = e
    side = (y - y1) * dx - (x - x1) * dy
    return F.when((y1 <= y) & (y2 > y) & (side > 0), 1).when((y1 > y) & (y2 <= y) & (side < 0), -1).otherwise(0)


def _winds_literal(x: Column, y: Column, e: Sequence[float]) -> Column | None:
    x1, y1, x2, y2 = e
    if y1 == y2:
        return None
    side = (y - y1) * _apart(x2, x1) - (x - x1) * _apart(y2, y1)
    if y1 < y2:
        return F.when((y >= y1) & (y < y2) & (side > 0), 1).otherwise(0)
    return F.when((y < y1) & (y >= y2) & (side < 0), -1).otherwise(0)


def _poly(x: Column, y: Column, xs: Sequence[float], ys: Sequence[float], eps: float | None, unrolled: int) -> Column:
    """Non-zero winding number, edges and vertices included unless ``eps`` is None."""
    sides = edges(xs, ys)
    if len(sides) <= unrolled:
        turns = [w for w in (_winds_literal(x, y, e) for e in sides) if w is not None]
        inside = reduce(lambda a, b: a + b, turns) != 0 if turns else F.lit(False)
        if eps is None:
            return inside
        corner = reduce(lambda a, b: a | b, ((x == a) & (y == b) for a, b in dict.fromkeys(zip(xs, ys))))
        on = reduce(lambda a, b: a | b, (_on_literal_edge(x, y, e, eps) for e in sides))
        return corner | on | inside
    rows = [(*e, _apart(e[2], e[0]), _apart(e[3], e[1])) for e in sides]
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2", "dx", "dy")))) for e in rows))
    if eps is None:
        return F.aggregate(table, F.lit(0), lambda n, e: n + _winds(x, y, [e[k] for k in ("x1", "y1", "x2", "y2", "dx", "dy")])) != 0

    def step(acc: Column, e: Column) -> Column:
        ends = (e["x1"], e["y1"], e["x2"], e["y2"])
        on = acc["on"] | F.coalesce(_on_edge(x, y, ends, eps), F.lit(False)) | ((x == ends[0]) & (y == ends[1]))
        return F.struct((acc["n"] + _winds(x, y, (*ends, e["dx"], e["dy"]))).alias("n"), on.alias("on"))

    acc = F.aggregate(table, F.struct(F.lit(0).alias("n"), F.lit(False).alias("on")), step)
    return acc["on"] | (acc["n"] != 0)


def gate(region: Region, x: Column, y: Column | None = None, eps: float | None = EPSILON, unrolled: int = UNROLLED, tx: Column | None = None, ty: Column | None = None) -> Column:
    """Whether the point lies in ``region``.

    Lines and rectangles are tested on raw coordinates with both bounds in;
    parts of dual and quad groups leave their upper bounds out. Ellipses and
    polygons are tested in transformed space, after their bounding box.
    ``eps``: how near to a polygon's side (as a share of it) a point lies on it, and so
    is in; None leaves sides and vertices to the winding number alone, so that
    polygons side by side share no points.
    ``tx`` and ``ty``: columns that hold the transformed axes already.

    The null and NaN tests come first in each conjunction, so it is never null
    and its bounds can still be pushed to the scan.
    """
    if region.type == "line":
        lo, hi = half(region.x[0], region.sync_part) if region.sync_kind == "dual" else (min(region.x), max(region.x))
        return _known(x) & _between(x, lo, hi, upper=region.sync_kind != "dual")
    if y is None:
        raise ValueError(f"region {region.label!r} needs two features")
    if region.type == "rect":
        bx, by, upper = region.x, region.y, True
        if region.sync_kind == "quad":
            (bx, by), upper = quarter(region.x[0], region.y[0], region.sync_part), False
        return _known(x, y) & _between(x, min(bx), max(bx), upper) & _between(y, min(by), max(by), upper)
    xs = [transform_value(v, region.xtrans) for v in region.x]
    ys = [transform_value(v, region.ytrans) for v in region.y]
    tx = transform(x, region.xtrans) if tx is None else tx
    ty = transform(y, region.ytrans) if ty is None else ty
    box = _known(tx, ty) & _between(tx, min(xs), max(xs)) & _between(ty, min(ys), max(ys))
    shape = _oval(tx, ty, xs, ys) if region.type == "oval" else _poly(tx, ty, xs, ys, eps, unrolled)
    return box & shape


def limits(values: Sequence[float] = (-math.inf, math.inf)) -> tuple[float, float]:
    """Least and greatest of the known values, as the limits of a group of regions."""
    known = [v for v in values if not math.isnan(v)]
    return (min(known), max(known)) if known else (math.inf, -math.inf)


def clipped(values: Sequence[float], lims: Sequence[float] = (-math.inf, math.inf)) -> list[float]:
    """The values strictly between the limits."""
    lo, hi = limits(lims)
    return [v for v in values if lo < v < hi]


def ellipse_points(region: Region, n: int = 100, theta: float = 2 * math.pi) -> list[tuple[float, float]]:
    """Outline of an ellipse's bounds, for drawing."""
    cx, cy = sum(region.x) / 2, sum(region.y) / 2
    rx, ry = abs(region.x[1] - region.x[0]) / 2, abs(region.y[1] - region.y[0]) / 2
    return [(cx + rx * math.cos(theta * i / (n - 1)), cy + ry * math.sin(theta * i / (n - 1))) for i in range(n)]
