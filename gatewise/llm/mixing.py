"""Operator 2: mixing sources to target weights by Pfair scheduling (DataFrame
functions only).

Each source's texts form blocks of equal size. A source with a of q parts of the
target owes its k-th block (from 0) no sooner than slot floor(k * q / a) and
before slot ceil((k + 1) * q / a); taking the released block with the earliest
deadline in every slot keeps all these windows, so that after any number of
slots each source is less than one block from its target weight.

The schedule is laid out in ranges of slots, each by itself. Which blocks come
before a range follows from its first slot alone: all whose deadline is reached,
and of the others that are released, in the order of their deadlines, those that
still fit in the slots since their releases (Hall's condition). That is where a
run from slot 0 would stand. It holds if no window is longer than a range, so
sources with less than 1 / SLOTS of the target share evenly spread slots of
their own, which leaves every window of both groups enough of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Slots of a range, or more where windows are longer.
SLOTS = 1024
BLOCK = 100_000
#: Parts of a source of size n without given weights: the square root of n, in units of 1 / ROOT.
ROOT = 1024
OUT = "array<struct<s:int,k:bigint,slot:bigint,release:bigint,deadline:bigint>>"


def parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in the ratio of the positive ``weights``; where exact ones sum
    to 2 ** 53 or more, rounded to that sum (1 at least)."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    if not exact:
        return {}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    shared, total = math.gcd(*out.values()), sum(out.values())
    if total // shared < 1 << 53:
        return {s: x // shared for s, x in out.items()}
    return {s: max(1, round(Fraction(x << 53, total))) for s, x in out.items()}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _product(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def floor_of(a: Column, b: Column, c: Column) -> Column:
    """floor(a * b / c) of whole numbers, exactly."""
    return F.call_function("div", _product(a, b), c.cast("decimal(18,0)"))


def ceil_of(a: Column, b: Column, c: Column) -> Column:
    return F.call_function("div", _product(a, b) + c.cast("decimal(18,0)") - 1, c.cast("decimal(18,0)"))


def _groups(sources: DataFrame) -> DataFrame:
    """One row for the sources whose windows fit in a range and one for the others:
    light, x (source, a, blocks by name), q, w (parts of the light ones), length
    and number of ranges. ``sources``: source, a, blocks; a schedule holds them all."""
    every = Window.partitionBy()
    known = sources.withColumn("q", F.sum("a").over(every)).withColumn("light", F.col("a") * SLOTS < F.col("q"))
    known = known.withColumn("w", F.coalesce(F.sum(F.when(F.col("light"), F.col("a"))).over(every), F.lit(0)))
    known = known.withColumn("last", ceil_of(F.col("blocks"), F.col("q"), F.col("a")))
    of = F.sort_array(F.collect_list(F.struct("source", "a", "blocks"))).alias("x")
    length = F.greatest(F.lit(SLOTS), F.ceil(F.max("q") / F.min("a")) + 2).cast("long").alias("length")
    out = known.groupBy("light").agg(of, F.max("q").alias("q"), F.max("w").alias("w"), length, F.max("last").alias("last"))
    return out.withColumn("ranges", F.ceil(F.col("last") / F.col("length")).cast("long"))


def _ahead(t: Column) -> Column:
    """Slots of the row's group before slot ``t``: the light ones' are spread evenly."""
    light = floor_of(t, F.col("w"), F.col("q"))
    return F.when(F.col("light"), light).otherwise(t - light)


def _state(done: Column, s: Column) -> Column:
    """Blocks that source number ``s`` has had, and the window of its next one."""
    a = F.get("x", s)["a"]
    return F.struct(done.alias("done"), floor_of(done, F.col("q"), a).alias("release"), ceil_of(done + 1, F.col("q"), a).alias("deadline"))


def _numbers() -> Column:
    return F.sequence(F.lit(0), F.size("x") - 1)


def _start() -> Column:
    """The sources' states when a range begins (column t)."""
    t, first = F.col("t"), F.greatest(F.lit(0).cast("long"), F.col("t") - F.col("length"))

    def of(due: Column) -> Column:
        def slack(a: Column) -> Column:
            """Slots from ``a`` on that blocks which are due leave free."""
            needed = F.zip_with(due, "x", lambda d, x: F.greatest(F.lit(0).cast("long"), d["done"] - ceil_of(a, x["a"], F.col("q"))))
            return _ahead(t) - _ahead(a) - F.aggregate(needed, F.lit(0).cast("long"), lambda s, n: s + n)

        def take(acc: Column, b: Column) -> Column:
            n = F.greatest(F.lit(0).cast("long"), b["release"] - first + 1).cast("int")  # slots up to the release
            least = F.coalesce(F.array_min(F.slice(acc["slack"], F.lit(1), n)), F.lit(1).cast("long"))
            fits = (acc["left"] > 0) & (least >= 1)
            less = F.struct(
                F.transform(acc["slack"], lambda h, i: h - (i < n).cast("long")).alias("slack"),
                F.array_append(acc["taken"], b["s"]).alias("taken"),
                (acc["left"] - 1).alias("left"),
            )
            return F.when(fits, less).otherwise(acc)

        begun = F.transform(due, lambda d, s: F.struct(d["deadline"].alias("deadline"), s.alias("s"), d["release"].alias("release")))
        begun = F.array_sort(F.filter(begun, lambda b: b["release"] < t))
        left = _ahead(t) - F.aggregate(due, F.lit(0).cast("long"), lambda s, d: s + d["done"])
        zero = F.struct(F.transform(F.sequence(first, t - 1), slack).alias("slack"), F.array().cast("array<int>").alias("taken"), left.alias("left"))
        return let(F.aggregate(begun, zero, take)["taken"], lambda taken: F.transform(due, lambda d, s: F.when(F.array_contains(taken, s), _state(d["done"] + 1, s)).otherwise(d)))

    due = F.transform(_numbers(), lambda s: _state(floor_of(t, F.get("x", s)["a"], F.col("q")), s))
    return F.when(t == 0, due).otherwise(let(due, of))


def _run() -> Column:
    """The blocks of a range, by earliest deadline first (ties: by name)."""
    mine = F.filter(F.sequence(F.col("t"), F.col("t") + F.col("length") - 1), lambda t: _ahead(t + 1) > _ahead(t))

    def step(acc: Column, t: Column) -> Column:
        ready = F.transform(acc["state"], lambda x, s: F.when(x["release"] <= t, F.struct(x["deadline"].alias("deadline"), s.alias("s"))))

        def put(s: Column) -> Column:
            x = F.get(acc["state"], s)
            entry = F.struct(s.alias("s"), x["done"].alias("k"), t.alias("slot"), x["release"].alias("release"), x["deadline"].alias("deadline"))
            state = F.transform(acc["state"], lambda y, i: F.when(i == s, _state(y["done"] + 1, s)).otherwise(y))
            return F.struct(state.alias("state"), F.array_append(acc["out"], entry).alias("out"))

        return let(F.array_min(ready)["s"], put)

    return F.aggregate(mine, F.struct(F.col("start").alias("state"), F.array().cast(OUT).alias("out")), step)["out"]


def schedule(sources: DataFrame) -> DataFrame:
    """source, block, slot, release, deadline of every block of ``sources`` (source,
    a: parts of the target, blocks: their number; longs)."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _groups(sources).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)))
    ranges = ranges.withColumn("t", F.col("j") * F.col("length")).repartition(n, "light", "j")
    laid = ranges.withColumn("start", _start()).select("x", F.explode(_run()).alias("b"))
    at = F.get("x", F.col("b.s"))
    return laid.filter(F.col("b.k") < at["blocks"]).select(at["source"].alias("source"), F.col("b.k").alias("block"), *(F.col(f"b.{c}").alias(c) for c in ("slot", "release", "deadline")))


def mix_order(rows: DataFrame, weights: Mapping[str, float] | None, block: int = BLOCK) -> DataFrame:
    """``rows`` (columns source, key, size and others) with start (the size that goes
    before in its source), block, slot, release and deadline. ``slot`` is null for
    sources without a weight.

    Within a source the order is by a hash (``key``), then id and size; rows go to
    the block in which they start.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"))
    if weights is None:
        sources = totals.withColumn("a", F.greatest(F.lit(1), F.round(F.sqrt(F.col("total").cast("double")) * ROOT)).cast("long"))
    else:
        sources = totals.join(spark.createDataFrame(list(parts(weights).items()), "source string, a long"), "source")
    sources = sources.select("source", "a", (F.floor((F.col("total") - 1) / block) + 1).cast("long").alias("blocks"))
    laid = common.saved(schedule(common.saved(sources, "sources")), "schedule")
    h = F.conv(F.substring(F.col("key"), 1, 8), 16, 10).cast("long")
    at = common.running(rows, "source", F.call_function("shiftleft", h, F.lit(32)), ["id", "size"], F.col("size"), "start")
    at = at.withColumn("block", F.floor(F.col("start") / block).cast("long"))
    return at.join(laid, ["source", "block"], "left")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    row = [F.struct("*").alias("row")] if whole else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))).alias("key")
    return docs.select(F.col(id_col).alias("id"), source, key, F.greatest(F.lit(1), F.length(text)).cast("long").alias("size"), *row)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size (characters, 1 at least),
    start, block, slot, release, deadline.

    ``weights``: target weight by source, of any number of them; without it,
    sources are weighed by the square root of their size. Null sources are
    "unknown"; sources without a positive weight get no slot (null) and come last
    in the mix. Where a source ends, its slots stay free. Null texts count as size
    1, a text longer than a block has one start; rows that repeat id and text are
    placed each, in any order; null ids are ordered by their texts. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = common.saved(_sized(docs, id_col, text_col, source_col, False), "sizes")
    out = mix_order(rows, weights, block)
    return out.select(F.col("id").alias(id_col), "source", "size", "start", "block", "slot", "release", "deadline")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, whole, in the order of the mix: by slot, then by start.

    Nulls, repeats and empty tables are handled as in ``mix_sources``; written as
    Parquet, the files hold the rows in this order (see ``packing.read_order``).
    """
    rows = _sized(docs, id_col, text_col, source_col, True)
    out = mix_order(rows, weights, block)
    return out.orderBy(F.asc_nulls_last("slot"), "source", "start").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_mixing over the whole of ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Slot by slot from the first one on, for any number of sources.
ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, greatest(1, length(coalesce(text, ''))) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS h
  FROM documents),
ran AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized),
part AS (
  SELECT source, greatest(1, round(sqrt(sum(size)::DOUBLE) * {ROOT}))::HUGEINT AS a, (sum(size)::BIGINT - 1) // {BLOCK} + 1 AS blocks FROM sized GROUP BY source),
lists AS (
  SELECT list(a ORDER BY source) AS a, list(source ORDER BY source) AS names, sum(a)::HUGEINT AS q,
         (SELECT max((p.blocks * t.q + p.a - 1) // p.a) FROM part p, (SELECT sum(a)::HUGEINT AS q FROM part) t) AS last
  FROM part),
laid AS (
  SELECT -1::BIGINT AS slot, list_transform(a, lambda x: 0::HUGEINT) AS done, NULL::BIGINT AS s, NULL::HUGEINT AS block, a, q, last FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p], a, q, last
  FROM (SELECT *, (list_min(list_filter(list_transform(done, lambda d, i: CASE WHEN d * q // a[i] <= slot + 1
               THEN ((d + 1) * q + a[i] - 1) // a[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000)::BIGINT AS p FROM laid)
  WHERE slot + 1 < last),
blocks AS (
  SELECT names[l.s] AS source, block::BIGINT AS block, slot, (block * l.q // l.a[l.s])::BIGINT AS release, (((block + 1) * l.q + l.a[l.s] - 1) // l.a[l.s])::BIGINT AS deadline
  FROM laid l, lists WHERE l.s IS NOT NULL)
SELECT doc_id, r.source, r.size, r.start, r.start // {BLOCK} AS block, b.slot, b.release, b.deadline
FROM ran r LEFT JOIN blocks b ON b.source = r.source AND b.block = r.start // {BLOCK}
"""
