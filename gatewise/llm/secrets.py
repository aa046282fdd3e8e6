"""Operator 7: secret scans with a guess-cost estimate for credential values.

Fixed patterns give the base spans. All values that stand in a credential
context, those of base spans too, are priced: the cheapest segmentation into
known words, dates, repeats, keyboard walks and brute-force spans, found by
dynamic programming, tells how many guesses a value stands. Costly ones outside
base spans are secrets of their own; cheap ones inside are marked as guessable.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The fixed patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more are those of one or more that pass
KINDS = ("assign", "access", "hex", "guess")
#: Credential contexts of the method; group 1 is the value.
CONTEXTS = (
    re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)["']?([^\x00-\x20"'<>,;|]{6,})""", re.ASCII | re.IGNORECASE),
    re.compile(r"""\bbearer\x20+([A-Za-z0-9+/_.=~-]{6,})""", re.ASCII | re.IGNORECASE),
    re.compile(r"""(?<=[a-z0-9+.-])://[^\x00-\x20:/@"'<>]+:([^\x00-\x20/@"'<>]{6,})@""", re.ASCII | re.IGNORECASE),
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "://")
#: Common words of passwords, most common first.
WORDS = (
    "password", "letmein", "welcome", "admin", "login", "master", "secret", "monkey", "dragon", "sunshine", "princess", "football", "baseball", "iloveyou", "trustno", "shadow", "superman", "batman", "michael", "jordan",
    "hunter", "ranger", "charlie", "summer", "winter", "spring", "autumn", "hello", "freedom", "whatever", "ninja", "mustang", "access", "flower", "passw0rd", "pass", "user", "test", "guest", "root",
    "change", "changeme", "default", "example", "sample", "token", "key", "api", "love", "money", "secure", "private", "public", "server", "system", "office", "home", "work", "city", "house",
    "monday", "friday", "sunday", "january", "march", "april", "june", "july", "august", "october", "december", "red", "blue", "green", "black", "white", "orange", "yellow", "purple", "silver",
    "your", "the", "and", "for", "not", "none", "null", "true", "false", "value", "here", "string", "name", "word", "code", "data", "file", "time", "this", "that",
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: How far the rows of keys are shifted, in keys, and the marks above the digits.
SHIFTS = (0.0, 0.5, 0.75, 1.25)
MARKS = str.maketrans("!@#$%^&*()", "1234567890")
#: Repeated blocks up to this length may start anywhere in a stretch of them, longer ones where it starts.
BLOCK = 16
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII)
SWAPS = str.maketrans("@4301$57", "aaeoisst")
#: Words of the corpus: runs of letters of these lengths.
LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 40
#: Words that a task counts before it gives them out, starts of parts that it lists
#: at once, and pairs of places that are compared at once.
HELD, STARTS, PAIRS = 1 << 18, 1 << 12, 1 << 18


@functools.cache
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}, max(map(len, words), default=0)


@functools.cache
def _near() -> dict[tuple[str, str], tuple[int, int]]:
    """Direction from each key to each one next to it, in its row or the rows beside
    it, and from letter to letter in the alphabet."""
    place = {ch: (x + shift, y) for y, (row, shift) in enumerate(zip(ROWS, SHIFTS)) for x, ch in enumerate(row)}
    out = {(a, b): ((bx > ax) - (bx < ax), by - ay) for a, (ax, ay) in place.items() for b, (bx, by) in place.items() if a != b and abs(bx - ax) <= 1 and abs(by - ay) <= 1}
    letters = "abcdefghijklmnopqrstuvwxyz"
    for a, b in zip(letters, letters[1:]):
        out.setdefault((a, b), (2, 0))
        out.setdefault((b, a), (-2, 0))
    return out


def walk_cost(keys: str) -> float | None:
    """log10 of the guesses for a walk over the keyboard, if ``keys`` is one."""
    near = _near()
    steps = [near.get(p) for p in zip(keys, keys[1:])]
    if len(keys) < 3 or None in steps:
        return None
    turns = sum(a != b for a, b in zip(steps, steps[1:]))
    return math.log10(2 * 40 * len(keys)) + turns * math.log10(4)


def _brute(ch: str) -> float:
    return math.log10(10 if ch.isdigit() else 26 if "a" <= ch.lower() <= "z" else 33)


def repetitions(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of each maximal stretch of a block of two characters or more,
    itself not a repeat, that stands at least twice in a row; by start, then end.

    A stretch of period p has two places p apart whose number p divides, so only
    these pairs are compared, by names of their parts of 1, 2, 4, ... characters:
    n log n pairs of log n steps each, exact, for a value of n characters.
    """
    n = len(value)
    if n < 4:
        return []
    chars = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    names = [np.unique(chars, return_inverse=True)[1].astype(np.int32)]
    while 2 << (len(names) - 1) <= n:
        half, last = 1 << (len(names) - 1), names[-1].astype(np.int64)
        names.append(np.unique(last[:-half] * (n + 1) + last[half:], return_inverse=True)[1].astype(np.int32))
    periods = np.arange(1, n // 2 + 1)
    ahead = np.concatenate([[0], np.cumsum((n - 1) // periods)])  # pairs of smaller periods
    found: dict[tuple[int, int], int] = {}
    for at in range(0, int(ahead[-1]), PAIRS):
        pair = np.arange(at, min(at + PAIRS, int(ahead[-1])))
        p = np.searchsorted(ahead, pair, "right")
        i = (pair - ahead[p - 1]) * p
        start, end = i.copy(), i + p
        for k in range(len(names) - 1, -1, -1):
            size, name = 1 << k, names[k]
            fits = np.flatnonzero(end + size <= n)
            fits = fits[name[end[fits] - p[fits]] == name[end[fits]]]
            end[fits] += size
            fits = np.flatnonzero(start >= size)
            fits = fits[name[start[fits] - size] == name[start[fits] - size + p[fits]]]
            start[fits] -= size
        for x in np.flatnonzero(end - start >= 2 * p):
            found.setdefault((int(start[x]), int(end[x])), int(p[x]))
    return sorted((a, b, p) for (a, b), p in found.items() if p > 1)


class _Starts:
    """The cheapest start of a span that costs ``v`` and log10 of its length.

    Of two starts the later one can be cheaper at first only, as the logarithm
    rises less and less: so later starts lie above earlier ones, each with the
    end from which the one below is cheaper, and is dropped for good there.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []

    def add(self, start: int, v: float, end: int) -> None:
        """A start whose spans end at ``end`` or later; ends never fall."""
        if self.stack and self.cost(end) <= v + math.log10(end - start):
            return
        while self.stack:
            low, w, until = self.stack[-1]
            ratio = 10 ** (v - w)
            cross = (ratio * start - low) / (ratio - 1) if ratio > 1 else math.inf
            if cross < until:
                self.stack.append((start, v, cross))
                return
            self.stack.pop()
        self.stack.append((start, v, math.inf))

    def cost(self, end: int) -> float:
        while self.stack[-1][2] <= end:
            self.stack.pop()
        start, v, _ = self.stack[-1]
        return v + math.log10(end - start)


def guess_cost(value: str, words: tuple[str, ...] = WORDS, more: Mapping[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    A word costs its rank (doubled for capitals or swapped letters), a date the
    days of 200 years, a repeat its letter times its length, a repeated block its
    own guesses times its number, a walk its start times its length and four at
    each turn, any other character its alphabet; each span costs 2 more. Repeats,
    walks and blocks may have any length, and any part of them may be a span, save
    that blocks of over BLOCK characters start where their stretch does.
    ``more``: ranks of words of the corpus; of two ranks the lower holds.
    """
    ranks, _ = _ranks(words)
    if more:
        ranks = {**more, **{w: min(r, more.get(w, r)) for w, r in ranks.items()}}
    return _cheapest(value, ranks, max(map(len, ranks), default=0), {w[:SHORTEST] for w in ranks}, {})


def _cheapest(value: str, ranks: Mapping[str, int], longest: int, begins: set[str], known: dict[str, float]) -> float:
    if value in known:
        return known[value]
    low, n, step = value.lower(), len(value), math.log10(2)
    # Lower case may be longer than a character: then letters stay as they are.
    low = low if len(low) == n else "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain, keys, near = low.translate(SWAPS), low.translate(MARKS), _near()
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    brute = math.inf  # cheapest with a brute-force span that ends here
    repeat, walk, walk_from, turns, ways = _Starts(), _Starts(), 0, [0] * (n + 1), [None] * (n + 1)
    same = 0
    opening: dict[int, list[tuple[int, int, int]]] = {}
    for stretch in repetitions(value):
        opening.setdefault(stretch[0], []).append(stretch)
    active: list[tuple[int, int, int, dict[int, _Starts]]] = []

    def own(a: int, p: int) -> float:
        return _cheapest(value[a : a + p], ranks, longest, begins, known)

    for i in range(n + 1):
        # Spans that end here, by their cheapest start.
        if i:
            one = _brute(value[i - 1])
            brute = min(brute + one, best[i - 1] + step + one)
            if i > 1 and value[i - 1] != value[i - 2]:
                same, repeat = i - 1, _Starts()
            if i - 3 >= same:
                repeat.add(i - 3, best[i - 3], i)
                best[i] = min(best[i], repeat.cost(i) + one + step)
            if i > 1:
                ways[i - 1] = near.get((keys[i - 2], keys[i - 1]))
                if ways[i - 1] is None:
                    walk_from, walk = i - 1, _Starts()
                else:
                    turns[i - 1] = turns[i - 2] + (i - 2 > walk_from and ways[i - 2] != ways[i - 1])
            if i - 3 >= walk_from:
                walk.add(i - 3, best[i - 3] - turns[i - 2] * math.log10(4), i)
                best[i] = min(best[i], walk.cost(i) + turns[i - 1] * math.log10(4) + math.log10(2 * 40) + step)
            active = [x for x in active if i <= x[1]]
            for a, _, p, starts in active:
                if i - 2 * p >= a:
                    of = starts.setdefault(i % p, _Starts())
                    of.add(i - 2 * p, best[i - 2 * p] + own(i - 2 * p, p), i)
                    best[i] = min(best[i], of.cost(i) - math.log10(p) + step)
            best[i] = min(best[i], brute)
        if i == n:
            break
        # Spans that start here.
        at = best[i] + step
        for a, b, p in opening.get(i, ()):
            if p <= BLOCK:
                active.append((a, b, p, {}))
            else:
                cost = own(a, p)
                for k in range(2, (b - a) // p + 1):
                    best[a + k * p] = min(best[a + k * p], at + cost + math.log10(k))
        for text, extra in ((low, 0), (plain, 1)):
            if text[i : i + SHORTEST] in begins:
                for j in range(i + SHORTEST, min(n, i + longest) + 1):
                    if (rank := ranks.get(text[i:j])) is not None:
                        best[j] = min(best[j], at + math.log10(rank) + step * extra + step * (value[i:j] != low[i:j]))
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], at + math.log10(200 * (365 if m.end() - i > 4 else 1)))
    known[value] = best[n]
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the spans of the fixed patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def values_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of each value in a credential context and each assigned value of a base span, in order."""
    if not any(h in text.lower() for h in HINTS):
        return []
    found = {m.span(1) for context in CONTEXTS for m in context.finditer(text)}
    return sorted(found | {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8})


def spans_of(text: str, least: float, words: tuple[str, ...] = WORDS, more: Mapping[str, int] | None = None) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, log10 guesses or 0) of every span, in order."""
    base = base_spans(text)
    free = [(a, b) for a, b in values_of(text) if not any(s <= a and b <= e for s, _, e in base)]
    priced = [(a, 3, b, guess_cost(text[a:b], words, more)) for a, b in free]
    return sorted([(*x, 0.0) for x in base] + [x for x in priced if x[3] >= least])


def _parts(text: str) -> Iterator[set[str]]:
    """Parts of runs of letters, as long as words, that a segmentation may take as a word; of a few starts at a time."""
    low, out = text.lower(), set()
    for t in (low, low.translate(SWAPS)):
        for m in LETTERS.finditer(t):
            for at in range(m.start(), m.end(), STARTS):
                out.update(t[i:j] for i in range(at, min(m.end(), at + STARTS)) for j in range(i + SHORTEST, min(m.end(), i + LONGEST) + 1))
                if len(out) >= STARTS:
                    yield out
                    out = set()
    yield out


def _values(text: str) -> set[str]:
    """The values in credential contexts."""
    return {text[a:b] for a, b in values_of(text)}


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: texts that have a word other than in a credential value."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for x in batch.column("text"):
            text = x.as_py() or ""
            own = {r for v in _values(text) for r in LETTERS.findall(v.lower())}
            counts.update(w for w in set(LETTERS.findall(text.lower())) - own if SHORTEST <= len(w) <= LONGEST)
            if len(counts) > HELD:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def dictionary(src: DataFrame) -> DataFrame:
    """word, n: every word of the texts and its number of texts, as a saved table."""
    return common.saved(src.select("text").mapInArrow(common.lean(_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def ranks_of(words: DataFrame) -> DataFrame:
    """n, rank: how many words of ``dictionary`` have at least n texts; one row per number of texts is put in sequence."""
    sizes = words.groupBy("n").agg(F.count("*").alias("words"))
    return sizes.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("rank"))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number, word: the words that may be in a value; in a long value some stand more than once."""
    for batch in batches:
        for number, x in zip(batch.column("number"), batch.column("value")):
            for part in _parts(x.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(part), pa.int64()), pa.array(list(part), pa.string())], names=["number", "word"])


def _priced(words: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [guess_cost(v.as_py(), words, {r["word"]: r["rank"] for r in x.as_py() or ()}) for v, x in zip(batch.column("value"), batch.column("ranks"))]
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("n"), pa.array(costs, pa.float64())], names=["value", "n", "guesses"])

    return run


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, base, values: the spans of the fixed patterns; values and whether one of these holds them."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    value = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("inside", pa.bool_()), ("value", pa.string())])
    for batch in batches:
        bases, values = [], []
        for x in batch.column("text"):
            text = x.as_py()
            base = base_spans(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            values.append([{"start": a, "end": b, "inside": any(s <= a and b <= e for s, _, e in base), "value": text[a:b]} for a, b in values_of(text)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bases, pa.list_(span)), pa.array(values, pa.list_(value))], names=["id", "base", "values"])


def prices(values: DataFrame, corpus: DataFrame, words: tuple[str, ...] = WORDS) -> DataFrame:
    """value, n, guesses: each distinct ``value``, its rows, and log10 of its guesses,
    with the words of the dictionary ``corpus`` as known; each is priced once."""
    values = common.saved(values.groupBy("value").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "values")
    asked = values.select("number", "value").mapInArrow(common.lean(_asked), "number long, word string")
    # Parts that no word is like go where they lie; common words are asked by many values.
    asked = common.flagged(asked, common.repeat_filter(corpus, F.xxhash64("word"), 1), F.xxhash64("word"), "like").filter("like").select("number", "word")
    asked = common.saved(asked.distinct(), "asked")
    times = asked.groupBy("word").agg(F.count("*").alias("times"))
    known = common.join_groups(asked, common.saved(times.join(corpus, "word").join(ranks_of(corpus), "n").drop("n"), "known"), ["word"], "times").filter("rank is not null")
    known = known.groupBy("number").agg(F.collect_list(F.struct("word", "rank")).alias("ranks"))
    return values.join(known, "number", "left").select("value", "n", "ranks").mapInArrow(_priced(words), "value string, n long, guesses double")


def secret_spans(docs: DataFrame, least: float = 8.0, words: tuple[str, ...] = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans (kind, start, end, guesses) by start,
    then kind, and values (start, end, inside, guesses) by start, then end; offsets
    count code points, ends are exclusive.

    ``values`` are all that stand in a credential context or are assigned in a
    base span, with log10 of their guesses, and whether a base span holds them;
    those that none holds are spans of kind guess from ``least`` on. Guesses of
    base spans are 0. Besides ``words``, all words of the texts (runs of 3 to 40
    letters) count as known, by their number of texts; a text doesn't count for
    the words of its own values; words of equally many texts share a rank. Null
    texts have no span; null and repeated ids pass through; other columns are
    ignored; whole texts and values of any length are scanned, in memory that
    grows with the longest text; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    found = src.mapInArrow(common.lean(_found), f"id {kind}, base array<struct<start:int,kind:int,end:int>>, values array<struct<start:int,end:int,inside:boolean,value:string>>")
    found = common.saved(found.withColumn("row", F.monotonically_increasing_id()), "found")
    values = found.select("row", F.explode("values").alias("v")).select("row", "v.*")
    priced = common.saved(prices(values.select("value"), dictionary(src), words), "priced")
    cost = common.join_groups(values, priced, ["value"], "n")
    cost = cost.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "inside", "guesses"))).alias("values"))
    some = found.filter(F.size("values") > 0).drop("values").join(cost, "row")
    none = found.filter(F.size("values") == 0).withColumn("values", F.array().cast(cost.schema["values"].dataType)).select(some.columns)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0.0).alias("guesses")))
    free = F.filter("values", lambda v: ~v["inside"] & (v["guesses"] >= least))
    guess = F.transform(free, lambda v: F.struct(v["start"].alias("start"), F.lit(3).alias("kind"), v["end"].alias("end"), v["guesses"].alias("guesses")))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat(base, guess)), lambda s: F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["guesses"].alias("guesses")))
    return none.unionByName(some).select(F.col("id").alias(id_col), spans.alias("spans"), "values")


def query(spark: SparkSession, sf_dir: str, least: float = 8.0) -> DataFrame:
    """op7_secret_scans over the whole of ``documents``; further columns: the number of
    credential values, of those under ``least``, and start:end:guesses of each."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), least)
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    priced = F.transform("values", lambda v: F.concat_ws(":", v["start"].cast("string"), v["end"].cast("string"), v["guesses"].cast("decimal(20,3)").cast("string")))
    valued = [
        F.size("values").cast("long").alias("n_values"),
        F.size(F.filter("values", lambda v: v["guesses"] < least)).cast("long").alias("n_guessable"),
        F.array_join(priced, ",").alias("priced"),
    ]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(named, ",").alias("spans"), *valued)
