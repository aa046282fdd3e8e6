"""Operator 3: quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a text whose metric lies over a cutoff. In each stratum
(language), labelled good texts give, for every cutoff of a grid, an exact
binomial p-value for "more than the allowed share of good texts is rejected".
From the loosest cutoff on, a fixed sequence of tests at a level divided by the
number of strata and rules certifies cutoffs; of these the one that rejects
most labelled bad texts, weighed against good ones, is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: Rules: a metric between 0 and 1 each; a text is rejected if its metric is over the cutoff.
RULES = ("symbols", "dup_lines", "repeats", "capitals", "word_length")
GRID = 500


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Number of words in 5-word windows that are found twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def covered(place: Column) -> Column:
        gaps = F.transform(place, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(place, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, j: (x["h"] == F.get(pairs, j - 1)["h"]) | (x["h"] == F.get(pairs, j + 1)["h"]))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def of(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(pairs, found))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: let(windows(h), of))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0).cast("long"))


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Id, stratum (null reads "und") and the base counts of each whole text (null: none)."""
    stratum = F.coalesce(F.col(stratum_col), F.lit("und")) if stratum_col else F.lit("all")
    src = docs.select(F.col(id_col).alias("id"), stratum.cast("string").alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    text = F.col("text")
    out = src.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        count_chars(text, CAPITALS).alias("n_capitals"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def bins() -> list[Column]:
    """For each rule the first grid step that isn't below the metric."""

    def step(part: str, whole: str, scale: int = 1) -> Column:
        whole_col = F.greatest(F.col(whole), F.lit(1)) * scale
        return F.least(F.ceil(F.col(part) * GRID / whole_col), F.lit(GRID)).cast("int")

    return [step("n_symbols", "word_chars"), step("n_dup_lines", "n_lines"), step("n_repeat_words", "n_words"), step("n_capitals", "word_chars"), step("word_chars", "n_words", 40)]


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 8."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    below = F.lit(0.0)
    for i in range(8):
        below = below + F.ln(x + i)
    return series - below


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at ``p``, for k below n * p: the terms from k
    downwards. The j-th is under exp(-j * (j - 1) / (2 * n * p)) times the first, so
    those beyond 9 * sqrt(n * p) + 10 are under the precision of a double."""
    nd, kd = n.cast("double"), k.cast("double")
    top = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    odds = (1 - p) / p

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (kd - j + 1) / (nd - kd + j) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    many = F.least(k, F.ceil(9 * F.sqrt(nd * p)) + 10).cast("int")
    steps = F.when(k >= 1, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    return F.exp(top) * F.aggregate(steps, start, add)["sum"]


def cutoffs(table: DataFrame, labels: DataFrame, risk: float, error: float, cost: float, label_id: str = "doc_id") -> DataFrame:
    """stratum, limits: for each stratum with labels one cutoff step per rule
    (GRID where none is certified). ``table``: metrics; ``labels``: id, quality 0/1."""
    marks = labels.filter(F.col(label_id).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(label_id).alias("id")).agg(F.min("quality").alias("good"))
    each = F.posexplode(F.array(*bins())).alias("rule", "step")
    held = table.filter("not base_failed").join(marks, "id").select("stratum", "good", each)
    counts = common.saved(held.groupBy("stratum", "rule", "step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "counts")
    tests = max(1, counts.select("stratum").distinct().count()) * len(RULES)
    # All steps of the grid, also those without a text: at most GRID + 1 per stratum and rule.
    kinds = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n")).select("stratum", "rule", "n", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("step"))
    over = Window.partitionBy("stratum", "rule").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    grid = kinds.join(counts, ["stratum", "rule", "step"], "left").select("stratum", "rule", "step", "n", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("good", "bad")))
    share = risk / len(RULES)
    tail = F.when(F.col("good") < F.col("n") * share, binomial_tail(F.col("n"), F.col("good"), share)).otherwise(1.0)
    # The sequence of tests goes from the loosest cutoff down and ends at the first failure.
    so_far = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))
    tested = grid.withColumn("pass", tail <= error / tests)
    tested = tested.withColumn("certified", F.min(F.col("pass").cast("int")).over(so_far) == 1)
    gain = F.col("bad") - cost * F.col("good")
    best = tested.filter("certified").groupBy("stratum", "rule").agg(F.max_by("step", F.struct(gain, F.col("step"))).alias("step"))
    at = F.map_from_entries(F.collect_list(F.struct("rule", "step")))
    limits = best.groupBy("stratum").agg(at.alias("m"))
    return limits.select("stratum", F.array(*(F.coalesce(F.col("m")[i], F.lit(GRID)) for i in range(len(RULES)))).alias("limits"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, cost: float = 20.0, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules (names, empty if kept by the rules).

    With probability 1 - ``error``, in no stratum do the rules reject more than
    ``risk`` of the good texts. Every stratum with labels has own cutoffs; texts
    of strata without enough labelled good texts fail by the base alone. Null texts
    have no words and fail; null strata are one stratum, "und"; null or repeated ids
    pass through row for row, and a label holds for each row of its id; labels of
    unknown ids or null quality are not used; of contradicting labels the worse
    counts; of cutoffs that gain alike the loosest is taken; whole texts of any
    length are counted; other columns are ignored; an empty table gives no rows.
    """
    table = common.saved(metrics(docs, id_col, text_col, stratum_col), "metrics")
    limits = common.saved(cutoffs(table, labels, risk, error, cost, label_id), "limits")
    out = table.join(limits, "stratum", "left")  # Spark chooses the join by the size of limits
    failed = F.filter(F.array(*(F.when(b > F.col("limits")[i], F.lit(RULES[i])) for i, b in enumerate(bins()))), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_quality_rules over the whole of ``documents``, with cutoffs from ``labels``;
    failed_rules as one text."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


def _step_sql(part: str, whole: str, scale: int = 1) -> str:
    return f"least(ceil({part} * {GRID} / (greatest({whole}, 1) * {scale})), {GRID})::INT"


_FAILED_SQL = ", ".join(f"CASE WHEN steps[{i + 1}] > coalesce(limits[{i}], {GRID}) THEN '{r}' END" for i, r in enumerate(RULES))
_SHARE = 0.02 / len(RULES)
ORACLE_SQL = rf"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM src),
windows AS (SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) x(k) GROUP BY r),
m AS (
  SELECT s.r, doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[{SYMBOLS}]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals
  FROM split s LEFT JOIN repeats p ON s.r = p.r),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [{_step_sql("n_symbols", "word_chars")}, {_step_sql("n_dup_lines", "n_lines")}, {_step_sql("n_repeat_words", "n_words")}, {_step_sql("n_capitals", "word_chars")}, {_step_sql("word_chars", "n_words", 40)}] AS steps
  FROM m),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
held AS (SELECT stratum, good, steps, unnest(range({len(RULES)})) AS rule FROM b JOIN marks USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT stratum, rule, steps[rule + 1] AS step, sum(good) AS good, sum(1 - good) AS bad FROM held GROUP BY ALL),
tests AS (SELECT greatest(1, count(DISTINCT stratum)) * {len(RULES)} AS n FROM counts),
grid AS (SELECT stratum, rule, n, unnest(range({GRID + 1}))::INT AS step FROM (SELECT stratum, rule, sum(good)::BIGINT AS n FROM counts GROUP BY ALL)),
rejected AS (
  SELECT g.stratum, g.rule, g.n, g.step, coalesce(sum(c.good) OVER w, 0)::BIGINT AS good, coalesce(sum(c.bad) OVER w, 0)::BIGINT AS bad
  FROM grid g LEFT JOIN counts c ON g.stratum = c.stratum AND g.rule = c.rule AND g.step = c.step
  WINDOW w AS (PARTITION BY g.stratum, g.rule ORDER BY g.step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cases AS (SELECT n, good, unnest(range(good + 1)) AS i FROM (SELECT DISTINCT n, good FROM rejected WHERE good < n * {_SHARE!r}::DOUBLE)),
tails AS (SELECT n, good, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}::DOUBLE) + (n - i) * ln(1 - {_SHARE!r}::DOUBLE))) AS tail FROM cases GROUP BY n, good),
tested AS (SELECT x.*, coalesce(tail, 1) <= 0.05 / (SELECT n FROM tests) AS pass FROM rejected x LEFT JOIN tails t ON x.n = t.n AND x.good = t.good),
certified AS (SELECT *, bool_and(pass) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS ok FROM tested),
best AS (SELECT stratum, rule, arg_max(step, (bad - 20 * good) * 1000 + step) AS step FROM certified WHERE ok GROUP BY ALL),
lim AS (SELECT stratum, map(list(rule), list(step)) AS limits FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM (SELECT b.*, array_to_string(list_filter([{_FAILED_SQL}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM b LEFT JOIN lim ON b.stratum = lim.stratum)
"""
