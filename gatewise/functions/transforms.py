"""Scale transforms of features, as columns and as numbers.

A transform is named by a text: ``P`` (identity), a number (lin-log with that
linear range), or ``name|argument|...``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lin_log(x: Column, hyper: float = 1000.0, base: float = 10.0, lin_comp: float | None = None) -> Column:
    """Linear up to ``hyper`` on either side of 0, logarithmic beyond."""
    k = _slope(base, lin_comp)
    return F.when(F.abs(x) <= hyper, x * F.lit(k / hyper)).otherwise(F.signum(x) * (k + k * F.ln(F.abs(x) / hyper)))


def inverse_lin_log(x: Column, hyper: float = 1000.0, base: float = 10.0, lin_comp: float | None = None) -> Column:
    k = _slope(base, lin_comp)
    return F.when(F.abs(x) <= k, x * F.lit(hyper / k)).otherwise(F.signum(x) * hyper * F.exp(F.abs(x) / k - 1))


def _slope(base: float, lin_comp: float | None) -> float:
    return 1.0 if lin_comp is None else math.log(base) / lin_comp


def _lin_log(x: float, hyper: float = 1000.0, base: float = 10.0, lin_comp: float | None = None) -> float:
    k = _slope(base, lin_comp)
    if math.isnan(x) or abs(x) <= hyper:
        return x * k / hyper
    return math.copysign(k + k * math.log(abs(x) / hyper), x)


def _inverse_lin_log(x: float, hyper: float = 1000.0, base: float = 10.0, lin_comp: float | None = None) -> float:
    k = _slope(base, lin_comp)
    if math.isnan(x) or abs(x) <= k:
        return x * hyper / k
    return math.copysign(hyper * math.exp(abs(x) / k - 1), x)


def _root(x: float) -> float:
    return math.sqrt(x) if x >= 0 else math.nan


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine, exact near 0 and for large negative values too."""
    a = F.abs(x)
    size = F.when(a > 1e150, F.ln(a) + math.log(2)).otherwise(F.log1p(a + a * a / (1 + F.sqrt(a * a + 1))))
    return F.signum(x) * size


#: Name: (column form, number form, name of the inverse).
TRANSFORMS: dict[str, tuple[Callable, Callable, str]] = {
    "return": (lambda x: x, lambda x: x, "return"),
    "smoothLinLog": (lin_log, _lin_log, "inv_smoothLinLog"),
    "inv_smoothLinLog": (inverse_lin_log, _inverse_lin_log, "smoothLinLog"),
    "smoothAsinh": (lambda x, hyper=1000.0: asinh(x / hyper), lambda x, hyper=1000.0: math.asinh(x / hyper), "inv_smoothAsinh"),
    "inv_smoothAsinh": (lambda x, hyper=1000.0: F.sinh(x) * hyper, lambda x, hyper=1000.0: math.sinh(x) * hyper, "smoothAsinh"),
    "asinh": (asinh, math.asinh, "sinh"),
    "sinh": (F.sinh, math.sinh, "asinh"),
    "sqrt": (F.sqrt, _root, "pow2"),
    "pow2": (lambda x: x * x, lambda x: x * x, "sqrt"),
}


def parse(spec: str | float | None) -> tuple[str, tuple[float, ...]]:
    """Name and arguments of a transform text."""
    text = "P" if spec is None else str(spec).strip()
    if text in ("P", "", "return"):
        return "return", ()
    try:
        return "smoothLinLog", (float(text),)
    except ValueError:
        name, *args = text.split("|")
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
    return name, tuple(float(a) for a in args if a)


def transform(x: Column, spec: str | float | None, inverse: bool = False) -> Column:
    """``x`` under the transform ``spec`` or its inverse; null and NaN stay."""
    name, args = parse(spec)
    return TRANSFORMS[TRANSFORMS[name][2] if inverse else name][0](x, *args)


def transform_value(x: float, spec: str | float | None, inverse: bool = False) -> float:
    """The same for one number on the driver (vertices of regions)."""
    name, args = parse(spec)
    return TRANSFORMS[TRANSFORMS[name][2] if inverse else name][1](float(x), *args)
