"""String, path and date columns of file handling and labels."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("MM/dd/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
PLACES = {"d": "dir", "p": "parent", "s": "short", "e": "ext", "o": "object", "c": "channel"}


def parsed_date(x: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in formats))


def formatted_date(x: Column, iso: bool = False, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Dates in ISO or TIFF form; what can't be read stays as it is."""
    shape = "yyyy-MM-dd'T'HH:mm:ss'Z'" if iso else "yyyy:MM:dd HH:mm:ss"
    return F.coalesce(F.date_format(parsed_date(x, formats), shape), x)


def base64_text(data: Column, url: bool = False) -> Column:
    text = F.regexp_replace(F.base64(data), r"\s", "")
    return F.translate(text, "+/", "-_") if url else text


def base64_bytes(text: Column, url: bool = False) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/") if url else text)


def capital_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def truncated(x: Column, n: int = 22) -> Column:
    """The first ``n`` characters and an ellipsis if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def resized(x: Column, n: int, justify: str = "none") -> Column:
    """Padded or cut to ``n`` characters; ``none`` pads nothing."""
    cut = F.substring(x, 1, n)
    pad = F.lit(n) - F.length(x)
    left = F.repeat(F.lit(" "), F.floor(pad / 2).cast("int"))
    wide = {"left": F.rpad(x, n, " "), "right": F.lpad(x, n, " "), "centre": F.concat(left, F.rpad(x, F.lit(n) - F.floor(pad / 2).cast("int"), F.lit(" "))), "none": x}[justify]
    return F.when(F.length(x) >= n, cut).otherwise(wide)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def replaced_specials(x: Column, by: str = "_", specials: str = r"[/\\:*?\"<>|]") -> Column:
    return F.regexp_replace(x, specials, by)


def path_parts(path: Column) -> dict[str, Column]:
    """dir, parent, short and ext of a path."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    folder = F.when(folder == "", F.lit(".")).otherwise(folder)
    return {"dir": folder, "parent": F.regexp_extract(folder, r"([^/]*)$", 1), "short": without_extension(F.regexp_extract(path, r"([^/]*)$", 1)), "ext": extension(path)}


def filled_template(template: str, path: Column, obj: Column | None = None, channel: Column | None = None) -> Column:
    """``template`` with %d %p %s %e from ``path`` and %o %c from the others."""
    parts = path_parts(path) | {"object": F.lit("") if obj is None else obj.cast("string"), "channel": F.lit("") if channel is None else channel.cast("string")}
    found = re.split(r"%([dpseoc])", template)
    return F.concat(*(parts[PLACES[x]] if i % 2 else F.lit(x) for i, x in enumerate(found)))


def number_text(x: Column) -> Column:
    """A number as written in files: shortest exact form, NaN for what is missing."""
    return F.coalesce(F.when(F.isnan(x), F.lit("NaN")).otherwise(F.upper(x.cast("string"))), F.lit("NaN"))


def mapped(x: Column, names: Mapping, strict: bool = False) -> Column:
    """Values by a table; others stay, or with ``strict`` become null."""
    if not names:
        return F.lit(None).cast("string") if strict else x
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    found = F.try_element_at(table, x)
    return found if strict else F.coalesce(found, x)


def fcs_name(label: Column) -> tuple[Column, Column]:
    """Short and long name of a ``name < stain >`` label."""
    both = r"^(.*) < (.*) >$"
    return F.when(label.rlike(both), F.regexp_extract(label, both, 1)).otherwise(label), F.regexp_extract(label, both, 2)


def escaped_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def contains_any(x: Column, patterns: list[str]) -> Column:
    """Whether any of the literal patterns occurs."""
    return x.rlike("|".join(map(re.escape, patterns))) if patterns else F.lit(False)


def sequence_position(x: Column, y: list[str]) -> Column:
    """1-based place at which the tokens ``y`` follow each other in the array; 0 if they don't."""
    n = len(y)
    hit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.slice(x, i, n) == F.array(*map(F.lit, y)))
    return F.when(F.size(x) >= n, F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0))).otherwise(0)


def sequence_replaced(x: Column, y: list[str], by: list[str]) -> Column:
    """The array with the first run of ``y`` replaced by ``by``."""
    at = sequence_position(x, y)
    new = F.array(*map(F.lit, by)) if by else F.array().cast("array<string>")
    out = F.concat(F.slice(x, F.lit(1), at - 1), new, F.slice(x, at + len(y), F.size(x)))
    return F.when(at > 0, out).otherwise(x)


def hex_color(x: Column) -> Column:
    """#rrggbb of a signed 32-bit ARGB number."""
    return F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 24))), 6, "0"))


def color_number(x: Column) -> Column:
    """The signed 32-bit number of an opaque #rrggbb colour."""
    return (F.conv(F.substring(x, 2, 6), 16, 10).cast("long") - (1 << 24)).cast("int")


def luminance(x: Column) -> Column:
    """Perceived brightness, 0 to 255, of a #rrggbb colour."""
    r, g, b = (F.conv(F.substring(x, 2 + 2 * i, 2), 16, 10).cast("double") for i in range(3))
    return F.sqrt(0.299 * r * r + 0.587 * g * g + 0.114 * b * b)
