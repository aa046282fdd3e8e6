"""Operator 12: fill-in-middle transformation in Spark SQL functions alone.

A text's units are the array of its regular expression matches; two cuts from the
hash of seed and id divide it, ``slice`` and ``array_join`` arrange the parts with
sentinels between them, and splitting at the sentinels restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED, RATE, SPM_RATE = 42, 50, 80


def draw(key: Column, i: int) -> Column:
    """The ``i``-th (from 0) 8 hex digits of a hash as a long."""
    return F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long")


def units(text: Column) -> Column:
    """White space with the word behind it, each; white space at the end is one."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def restored(output: Column, form: Column) -> Column:
    """The text from ``output`` and its ``form``."""
    part = F.split(output, SENTINEL)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if
    plain) and output of each row, without a shuffle.

    ``rate`` in 100 texts are rearranged, ``spm_rate`` in 100 of them suffix first.
    Empty texts and those that hold a sentinel stay plain. A null text is empty; a
    null id is drawn for as "null"; rows that repeat an id and text have equal results;
    texts of any length are whole; other columns are ignored; an empty table
    gives no rows.
    """
    src = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    plain = (F.col("_text") == "") | F.col("_text").rlike(SENTINEL) | (draw(F.col("_key"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("_key"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    src = src.withColumn("_key", key).withColumn("_units", units(F.col("_text"))).withColumn("form", form)
    n = F.size("_units").cast("long")
    cuts = [(draw(F.col("_key"), i) % (n + 1)).cast("int") for i in (0, 1)]
    src = src.withColumn("_a", F.least(*cuts)).withColumn("_b", F.greatest(*cuts)).withColumn("n", n)

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))

    a, b, size = F.col("_a"), F.col("_b"), F.col("n").cast("int")
    src = src.withColumn("prefix", part(F.lit(1), a)).withColumn("middle", part(a + 1, b - a)).withColumn("suffix", part(b + 1, size - b))
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return src.select(id_col, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_fill_in_middle over the whole of ``documents``."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH src AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
           regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u
    FROM documents),
drawn AS (
    SELECT *, len(u) AS n, ('0x' || k[1:8])::BIGINT AS h1, ('0x' || k[9:16])::BIGINT AS h2, ('0x' || k[17:24])::BIGINT AS h3, ('0x' || k[25:32])::BIGINT AS h4
    FROM src),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
                WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s
    FROM cut),
made AS (
    SELECT *, CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END AS o
    FROM parts),
back AS (SELECT *, CASE WHEN form = 'plain' THEN [''] ELSE string_split_regex(o, '{SENTINEL}') END AS x FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(o) AS output_sha256, sha256(CASE form WHEN 'psm' THEN x[2] || x[4] || x[3] WHEN 'spm' THEN x[3] || x[4] || x[2] ELSE o END) AS restored_sha256
FROM back
"""
