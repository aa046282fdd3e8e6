"""Operator 11: spelling variants by merging the light subtrees of a trie.

The words are a trie whose nodes are fingerprints of prefixes. Each node has one
heavy child, the one with the most words below it; the others, and a word that ends
there, are light. A word passes at most log2(words) light children, and only
there it is merged into the rest of the node's subtree, always the smaller side
into the larger: with the character skipped, with the heavy child's character in
its place or before it, and with any character in its place (which the
light subtrees of the node share). Where a merged word coincides with a terminal, or
with another merged one, the two words are one edit apart. Two such words part at one
node and one of them is light there, so every pair is found, and found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: A run loses a character where its hash is a multiple of this.
DROP = 199
#: Words, and characters of them, that a task counts before it hands its counts on.
HELD_WORDS, HELD_CHARS = 200_000, 1 << 24
#: Characters of words whose prefixes are computed at a time.
BLOCK = 1 << 18
#: A prefix's fingerprint: its polynomial value modulo four primes, two to a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1812433253, 1664525, 69069069)
#: Stands for any character in a merged word, and for the end of a word in the trie.
ANY, END = "\0", 0


def _counts(least: int, drop: int):
    run_of_letters = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return got

        for batch in batches:
            for doc_id, text in zip(batch.column("id"), pc.ascii_lower(batch.column("text"))):
                seed = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for word, n in Counter(run_of_letters.findall(text.as_py())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % drop == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    if word not in total:
                        chars += len(word)
                    total[word] += n
                if len(total) > HELD_WORDS or chars > HELD_CHARS:
                    yield out()
                    chars = 0
        yield out()

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts, counted in the tasks and then added up."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = src.mapInArrow(common.lean(_counts(least, drop)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _packed(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, row: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """Two longs for the prefix of each ``depth`` of the word ``row``; ``codes``
    are all words' characters in sequence, and ``depth`` runs from 0 to a word's length."""
    longest = int(lengths.max(initial=0)) + 1
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    halves = []
    for prime, base in zip(PRIMES, BASES):
        power = np.empty(longest, np.uint64)
        power[0], k, step = 1, 1, base % prime
        while k < longest:
            m = min(k, longest - k)
            power[k : k + m] = power[:m] * np.uint64(step) % np.uint64(prime)
            k, step = k + m, step * step % prime
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[place] % np.uint64(prime), out=run[1:])
        at = starts[row]
        # A different value for each depth, so that no prefix is a longer one's with zeros.
        halves.append((run[at + depth] - run[at] + (depth.astype(np.uint64) + np.uint64(1)) * np.uint64(base // 3)) % np.uint64(prime))
    shift = np.uint64(31)
    return [((a << shift) | b).astype(np.int64) for a, b in (halves[:2], halves[2:])]


def _blocks(words: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum([0, *pc.utf8_length(words).to_pylist()])
    yield from common.chunks(sizes, BLOCK)


def _nodes(with_words: bool):
    """Rows of the trie: a node, the character that a word goes on with from there
    (END where it ends), and the word or how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            for i, j in _blocks(column):
                words = column.slice(i, j - i).to_pylist()
                lengths = np.array([len(w) for w in words], np.int64)
                codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
                starts = np.cumsum(lengths) - lengths
                row = np.repeat(np.arange(len(words)), lengths + 1)
                depth = np.arange(len(row)) - np.repeat(starts + np.arange(len(words)), lengths + 1)
                goes = np.where(depth < lengths[row], np.append(codes, END)[np.minimum(starts[row] + depth, len(codes))], END).astype(np.int32)
                a, b = _packed(codes, starts, lengths, row, depth)
                if with_words:
                    ids = [x.astype(np.int64) for x in (a[depth == lengths[row]], b[depth == lengths[row]])]
                    cols = [a, b, goes, ids[0][row], ids[1][row], depth]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "c", "wa", "wb", "depth"])
                else:
                    of, n = np.unique(np.stack([a, b, goes.astype(np.int64)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(of[1]), pa.array(of[2].astype(np.int32)), pa.array(n)], names=["a", "b", "c", "n"])

    return run


def branches(words: DataFrame) -> DataFrame:
    """a, b, heavy, n of each node with two ways on: its heavy child's character and
    how many words pass it. Ties go to the smaller character."""
    ways = words.select("word").mapInArrow(common.lean(_nodes(False)), "a long, b long, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    of = F.max(F.when(F.col("c") != END, F.struct("n", (-F.col("c")).alias("c"))))
    nodes = ways.groupBy("a", "b").agg(F.count("*").alias("ways"), F.sum("n").alias("n"), (-of["c"]).alias("heavy"))
    return nodes.filter("ways > 1").select("a", "b", "heavy", "n")


MERGED = "kind string, merged string, word string, n long"


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words with the fingerprints of all of each."""
    for batch in batches:
        column = batch.column("word")
        for i, j in _blocks(column):
            part = column.slice(i, j - i)
            words = part.to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
            a, b = _packed(codes, np.cumsum(lengths) - lengths, lengths, np.arange(len(words)), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), part, batch.column("n").slice(i, j - i)], names=["wa", "wb", "word", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a word becomes at each node where it is light."""
    for batch in batches:
        kind, merged, rows, chars = [], [], [], 0
        for row, (word, at) in enumerate(zip(batch.column("word").to_pylist(), batch.column("light").to_pylist())):
            for node in at:
                d, heavy = node["depth"], node["heavy"]
                before, here, after = word[:d], word[d : d + 1], word[d + 1 :]
                found = [("word", before + chr(heavy) + here + after)] if heavy is not None else []
                if here:
                    if heavy is not None:
                        found.append(("word", before + chr(heavy) + after))
                    if after[:1] != here:  # else the words part at a later node
                        found.append(("word", before + after))
                    found.append(("any", before + ANY + after))
                for k, m in found:
                    kind.append(k)
                    merged.append(m)
                    rows.append(row)
                    chars += 2 * len(word)
            if chars > HELD_CHARS:
                yield _rows(batch, kind, merged, rows)
                kind, merged, rows, chars = [], [], [], 0
        yield _rows(batch, kind, merged, rows)


def _rows(batch: pa.RecordBatch, kind: list, merged: list, rows: list) -> pa.RecordBatch:
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(merged, pa.string()), batch.column("word").take(take), batch.column("n").take(take)], names=["kind", "merged", "word", "n"])


def merged_words(words: DataFrame) -> DataFrame:
    """kind, merged, word, n: every word at every node where it is light, merged into
    the node's subtree. ``words`` (word, n) is a saved table."""
    nodes = common.saved(branches(words), "branches")
    paths = words.select("word").mapInArrow(common.lean(_nodes(True)), "a long, b long, c int, wa long, wb long, depth long")
    # All words pass the nodes near the root: those are the hot groups of this join.
    on = common.join_groups(paths, nodes, ["a", "b"], "n").filter("n is not null and (heavy is null or c <> heavy)")
    light = on.groupBy("wa", "wb").agg(F.collect_list(F.struct(F.col("depth").cast("int").alias("depth"), "heavy")).alias("light"))
    whole = words.select("word", "n").mapInArrow(common.lean(_ids), "wa long, wb long, word string, n long")
    return whole.join(light, ["wa", "wb"]).select("word", "n", "light").mapInArrow(common.lean(_merged), MERGED)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (negative count and spelling of the most frequent near word)
    of each word with near words; ``words`` (word, n) is a saved table."""
    merged = common.saved(merged_words(words), "merged")
    # Each pair once; both ends learn of it.
    ends = merged.filter("kind = 'word'").select("merged", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = common.saved(ends.join(words, ends["merged"] == words["word"]).select("word", "n", "other", "other_n"), "pairs")
    told = pairs.select("word", F.lit(1).alias("near"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("best"))
    told = told.unionByName(pairs.select(F.col("other").alias("word"), F.lit(1).alias("near"), F.struct((-F.col("n")).alias("n"), "word").alias("best")))
    # Light subtrees that share a merged word: one word for each letter at most. Each of them
    # is told of the first of the others, without their pairs.
    group = merged.filter("kind = 'any'").groupBy("merged").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all")).filter(F.size("all") > 1)
    member = group.select("all", F.posexplode("all").alias("at", "self"))
    told = told.unionByName(member.select(F.col("self.word").alias("word"), (F.size("all") - 1).alias("near"), F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best")))
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that each word of ``forms`` (word, form) leads to.
    Counts grow at every step, so there is no cycle, and the steps halve each round."""
    at = common.saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        # A form has one row for each of its near words at most, so no key is hot.
        ahead = at.select(F.col("word").alias("_of"), F.col("root").alias("_next"))
        step = common.saved(at.join(ahead, at["root"] == ahead["_of"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").limit(1).count() == 0:
            return at


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = LEAST_RATIO, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: the words of all texts (runs of letters A-Z
    and U+00C0 to U+00FF, A-Z lower-cased) of ``least`` characters and ``least_count``
    occurrences.

    Near words are one inserted, deleted or replaced character apart. A word's form is
    its most frequent near word (ties: the first in code-point order) if that has
    ``ratio`` times the word's count; ``root`` ends the chain of forms. A run loses
    a character where the crc32 of id and run is a multiple of ``drop``.

    Null texts have no words; a null id reads as "null"; repeated rows count each;
    texts and words of any length are whole; other columns are ignored; an empty
    table, or one without such words, gives no rows.
    """
    words = common.saved(word_counts(docs, least, least_count, drop, id_col, text_col), "words")
    near = near_words(words)
    out = words.join(near, "word", "left")
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    out = common.saved(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")), "variants")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_spelling_variants over the whole of ``documents``."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
