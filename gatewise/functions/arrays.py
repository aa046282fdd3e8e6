"""Images as flat row-major arrays: what needs no Python runs as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import is_finite

#: Values at or below this are background marks and don't count in ranges.
FLOOR = -4095.0


def pixel_range(pixels: Column) -> tuple[Column, Column]:
    """Least (above the floor) and greatest of the finite values."""
    ok = F.filter(pixels, is_finite)
    return F.array_min(F.filter(ok, lambda v: v > FLOOR)), F.array_max(ok)


def normalized(pixels: Column, lo: Column | float, hi: Column | float, gamma: float = 1.0) -> Column:
    """0 at ``lo`` and below, 1 at ``hi`` and above, a power between."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)

    def scaled(v: Column) -> Column:
        part = (v - lo) / width
        return F.when(v <= lo, F.lit(0.0)).when(v >= hi, F.lit(1.0)).otherwise(part if gamma == 1.0 else F.pow(part, F.lit(gamma)))

    return F.transform(pixels, lambda v: scaled(v.cast("double")))


def quantile_range(pixels: Column, low: float, high: float) -> tuple[Column, Column]:
    """Interpolated quantiles of an image's own values."""
    at = F.array_sort(F.filter(pixels, is_finite))

    def quantile(p: float) -> Column:
        h = (F.size(at) - 1) * F.lit(p)
        i = F.floor(h).cast("int")
        a, b = F.get(at, i).cast("double"), F.get(at, F.least(i + 1, F.size(at) - 1)).cast("double")
        return a + (h - i) * (b - a)

    return quantile(low), quantile(high)


def full_range(pixels: Column) -> Column:
    return normalized(pixels, 0.0, 4095.0)


def force_range(pixels: Column) -> Column:
    return normalized(pixels, *pixel_range(pixels))


def where_mask(a: Column, b: Column, mask: Column) -> Column:
    """``b`` where the mask is set, else ``a``."""
    return F.transform(a, lambda v, i: F.when(F.get(mask, i) != 0, F.get(b, i)).otherwise(v))


def cleansed(pixels: Column, mask: Column, background: Column | float) -> Column:
    """Background in place of the pixels under the mask."""
    bg = background if isinstance(background, Column) else F.lit(float(background))
    return F.transform(pixels, lambda v, i: F.when(F.get(mask, i) != 0, bg).otherwise(v.cast("double")))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def negated(a: Column) -> Column:
    return F.transform(a, lambda x: ~x)


def composite(channels: list[tuple[float, Column]]) -> Column:
    """Weighted sum of channels; the weights add up to 1."""
    if abs(sum(w for w, _ in channels) - 1) > 1e-9:
        raise ValueError("the weights of a composite add up to 1")
    (w, first), *rest = channels
    out = F.transform(first, lambda v: v.cast("double") * w)
    for w, more in rest:
        out = F.zip_with(out, more, _plus(w))
    return out


def _plus(w: float):
    return lambda s, v: s + v.cast("double") * w


def removal_mask(mask: Column, removal: str, all_masks: Column | None = None) -> Column:
    """1 for pixels to remove: none, raw, clipped (mask over 1), masked (mask not 1),
    or MC (no channel's mask is 1; ``all_masks``: an array of masks)."""
    if removal in ("none", "raw"):
        return F.transform(mask, lambda m: F.lit(0))
    if removal == "clipped":
        return F.transform(mask, lambda m: (m > 1).cast("int"))
    if removal == "masked":
        return F.transform(mask, lambda m: (m != 1).cast("int"))
    if removal == "MC":
        return F.transform(mask, lambda m, i: (~F.exists(all_masks, lambda k: F.get(k, i) == 1)).cast("int"))
    raise ValueError(f"unknown removal {removal!r}")


def cropped(pixels: Column, height: int, width: int, new_height: int, new_width: int, front: bool = False) -> Column:
    """The centre of an image; an odd pixel is cut at the end, or at the front.
    Sizes of 0, or larger than the image, leave that side as it is."""
    h, w = (new_height if 0 < new_height < height else height), (new_width if 0 < new_width < width else width)
    top, left = ((n - m) // 2 + (front and (n - m) % 2) for n, m in ((height, h), (width, w)))
    rows = F.transform(F.sequence(F.lit(top), F.lit(top + h - 1)), lambda r: F.slice(pixels, r * width + left + 1, F.lit(w)))
    return F.flatten(rows)


def padded(pixels: Column, height: int, width: int, new_height: int, new_width: int, background: float = 0.0, front: bool = False) -> Column:
    """The image in the centre of a larger one; an odd pixel goes to the end, or to the front."""
    h, w = max(height, new_height), max(width, new_width)
    top, left = ((n - m) // 2 + (front and (n - m) % 2) for n, m in ((h, height), (w, width)))
    bg = F.lit(float(background))

    def row(r: Column) -> Column:
        own = F.transform(F.slice(pixels, (r - top) * width + 1, F.lit(width)), lambda v: v.cast("double"))
        line = F.concat(F.array_repeat(bg, left), own, F.array_repeat(bg, w - width - left))
        return F.when((r >= top) & (r < top + height), line).otherwise(F.array_repeat(bg, w))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), row))


def resized(pixels: Column, height: int, width: int, new_height: int, new_width: int, background: float = 0.0, front: bool = False) -> Column:
    """Cropped, then padded to the wanted size."""
    out = cropped(pixels, height, width, new_height, new_width, front)
    h, w = (min(n, m) if m else n for n, m in ((height, new_height), (width, new_width)))
    return padded(out, h, w, new_height, new_width, background, front)
