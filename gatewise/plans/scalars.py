"""Queries of strings, paths, dates and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, strings
from .common import query, table


@query("SELECT doc_id, replace(replace(base64(encode(coalesce(text, ''))), '+', '-'), '/', '_') AS b64, true AS same FROM documents")
def base64_url(spark, sf_dir):
    """Base64 in its URL form, and back, of the whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    text = strings.base64_text(F.col("data"), url=True)
    return docs.select("doc_id", text.alias("b64"), (strings.base64_bytes(text, url=True) == F.col("data")).alias("same"))


@query(
    "SELECT page_id, coalesce(nullif(regexp_extract(url, '^(.*)/[^/]*$', 1), ''), '.') || '/' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^./]*$', '') || '_' || page_id || '.tif' AS path, "
    "lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext FROM pages"
)
def path_template(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", strings.filled_template("%d/%s_%o.tif", F.col("url"), obj=F.col("page_id")).alias("path"), strings.extension(F.col("url")).alias("ext"))


_D, _H, _MIN, _S = "(o_orderkey % 28 + 1)", "(o_orderkey % 24)", "(o_orderkey % 60)", "(o_orderkey // 60 % 60)"
_ISO = f"printf('2020-01-%02dT%02d:%02d:%02dZ', {_D}, {_H}, {_MIN}, {_S})"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'yesterday' ELSE {_ISO} END AS iso FROM orders")
def date_formats(spark, sf_dir):
    """Dates as files write them, in several forms, and what is none."""
    k = F.col("o_orderkey")
    day, hour, minute, second = k % 28 + 1, k % 24, k % 60, F.floor(k / 60) % 60
    forms = [
        F.format_string("01/%02d/2020 %02d:%02d:%02d %s", day, (hour + 11) % 12 + 1, minute, second, F.when(hour < 12, "AM").otherwise("PM")),
        F.format_string("%02d/01/2020 %02d:%02d:%02d", day, hour, minute, second),
        F.format_string("2020:01:%02d %02d:%02d:%02d", day, hour, minute, second),
        F.format_string("2020-01-%02dT%02d:%02d:%02dZ", day, hour, minute, second),
        F.lit("yesterday"),
    ]
    text = F.get(F.array(*forms), (k % 5).cast("int"))
    # In the second form days up to 12 read as months, so the day comes after those here.
    text = F.when((k % 5 == 1) & (day <= 12), forms[2]).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.formatted_date(text, iso=True).alias("iso"))


@query(
    "SELECT p_partkey, reverse(p_name) AS reversed, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capital, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS short, "
    "CASE WHEN length(p_brand) >= 12 THEN substr(p_brand, 1, 12) ELSE lpad(p_brand, 12, ' ') END AS padded, regexp_replace(p_type, '[ ]', '_', 'g') AS plain FROM part"
)
def string_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.reverse("p_name").alias("reversed"),
        strings.capital_first(F.col("p_type")).alias("capital"),
        strings.truncated(F.col("p_name"), 8).alias("short"),
        strings.resized(F.col("p_brand"), 12, "right").alias("padded"),
        strings.replaced_specials(F.col("p_type"), specials="[ ]").alias("plain"),
    )


@query("SELECT user_id, (user_id * 7919 * 65537) % 4294967296 AS u, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END::INT AS i, CASE WHEN value > 0 THEN round(ln(value), 6) END AS l FROM (SELECT DISTINCT user_id, min(value) OVER (PARTITION BY user_id) AS value FROM events)")
def number_casts(spark, sf_dir):
    """Unsigned and signed readings of 32-bit numbers, logarithms of positive values."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("value"))
    u = numbers.uint32(F.col("user_id") * 7919 * 65537)
    return rows.select("user_id", u.alias("u"), numbers.int32(u).alias("i"), F.round(numbers.finite(numbers.natural_log(F.col("value"))), 6).alias("l"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'NATION_1' THEN 'N1' ELSE n_name END AS code, '#' || lpad(upper(to_hex(n_nationkey * 1000)), 6, '0') AS color, round(sqrt(0.587 * pow((n_nationkey * 1000) // 256, 2) + 0.114 * pow((n_nationkey * 1000) % 256, 2)), 6) AS light FROM nation")
def color_maps(spark, sf_dir):
    color = strings.hex_color(F.col("n_nationkey") * 1000)
    return table(spark, sf_dir, "nation").select("n_nationkey", strings.mapped(F.col("n_name"), {"FRANCE": "FR", "NATION_1": "N1"}).alias("code"), color.alias("color"), F.round(strings.luminance(color), 6).alias("light"))
