"""Operator 6: best-fit packing after dominance reduction.

Tokens are counted per piece; packing itself works on the number of pieces of
each length (at most ``capacity`` numbers, whatever the corpus): the reduction
fixes sets of two or three lengths that dominate all alternatives, best fit
decreasing places the rest, and both yield a plan of ranges: pieces of length l
and rank a..b lie in sequences s.., at one offset. Pieces find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
#: Rows that are packed together where sequences follow the order of the rows.
ROWS = 1 << 14
#: Runs of non-space characters kept with their ids by each worker before it starts anew.
KEPT_WORDS = 160_000
#: Bytes of texts that are encoded together.
AT_ONCE = 1 << 22
#: Texts of these characters only are lower-cased and split alike by all libraries.
PLAIN = re.compile("[\x00\x02-\x1b\x21-~\x20\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb4\xb6-\xb8\xbb\xbf-ÿĀ-įĲ-ſ‐-‧€]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+| ")
#: Stands for the end of a word in the rank table; texts that hold it go another way.
END = "\x01"


class Encoder:
    """Ids of a word-level BPE file (word ends marked in its vocabulary), as bytes
    of little-endian unsigned 32-bit numbers.

    A single text's runs of non-space characters are encoded once and kept, which takes the least memory.
    Of texts that are encoded together (``many``) each distinct run of non-space characters goes through the
    merges once; ids are then dealt to the texts as arrays. The merges run as ranks of byte strings, in which END stands for the end of a word. Texts outside PLAIN, or with END or a
    special token's string in them, go through the tokenizer file itself.
    """

    def __init__(self, file: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = [x["content"].lower() for x in spec["added_tokens"]]
        bytes_of = {c: b for b, c in _CHARS.items()}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(bytes_of[c] for c in token.removesuffix(suffix)) + END.encode() * ends

        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        order = [*_CHARS.values(), *(c + suffix for c in _CHARS.values()), *(a + b for a, b in merges)]
        ranks = {raw(t): i for i, t in enumerate(order)}
        self.ids = np.array([vocab[t] for t in order], "<u4")
        self.gap = ranks[raw(_CHARS[0x20] + suffix)]  # a space between two runs, which no text's ids have
        merged = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.piece, self.kept = merged.encode_to_numpy, merged._encode_single_piece, self.ids.tolist()
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids, piece = self.kept, self.piece
        parts = (word,) if word.isalpha() and word.isascii() else PLAIN_WORD.findall(word)
        found = [ids[i] for part in parts for i in piece(part + END)]
        got = struct.pack(f"<{len(found)}I", *found)
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        self.words[word] = got
        return got

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``words``, one after the other, and where each one's begin and the last one's end."""
        got = self.pieces(END.join([*PLAIN_WORD.findall(" ".join([*words.to_pylist(), ""])), ""]), disallowed_special=())
        gaps = np.flatnonzero(got == self.gap)
        return self.ids[np.delete(got, gaps)], np.append(0, gaps - np.arange(len(gaps)))

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-case texts of PLAIN characters."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, begin = self.distinct(coded.dictionary)
        n = np.diff(begin)[at]
        ends = np.cumsum(n)
        place = np.repeat(begin[at] - ends + n, n)
        place += np.arange(len(place))
        data = ids[place].tobytes()
        cuts = (4 * np.append(0, ends)[words.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def many(self, texts: list[str | None]) -> list[bytes]:
        out, plain, which = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            low = (text or "").lower()
            if PLAIN.fullmatch(text or "") and not any(s in low for s in self.special):
                plain.append(unicodedata.normalize("NFC", low))
                which.append(i)
            else:
                out[i] = np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for i, ids in zip(which, self.plain(plain)):
            out[i] = ids
        return out

    def __call__(self, text: str) -> bytes:
        low = text.lower()
        if PLAIN.fullmatch(text) and not any(s in low for s in self.special):
            have, word = self.words.get, self.word  # no match of PLAIN_WORD in a run has a space in it
            return b"".join([have(w) or word(w) for w in unicodedata.normalize("NFC", low).split()])
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Byte to the printable character that stands for it in byte-level vocabularies.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


@common.kept
def encoder(file: str) -> Encoder:
    return Encoder(file)


def encoded(encode: Encoder, col: pa.Array) -> Iterator[bytes]:
    """Ids of each text, some AT_ONCE bytes at a time."""
    n = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    for i, j in common.chunks(np.append(0, np.cumsum(n, dtype=np.int64)), AT_ONCE):
        yield from encode.many(col.slice(i, j - i).to_pylist())
    common.release()  # what arrays of all sizes have left behind


def _pieces(file: str, capacity: int, end_id: int, with_ids: bool, carried: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            cols, names = [*cols, *(batch.column(c).take(pa.array(rows, pa.int64())) for c in carried)], [*names, *carried]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, as bytes of u32) of each
    ``capacity``-token piece of each text and its end id, with the columns
    ``carried`` of its row; null texts are empty."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in carried)
    long_schema = schema.replace("piece int", "piece long")
    out = src.mapInArrow(common.lean(_pieces(file, capacity, end_id, with_ids, carried), encoder), long_schema)
    return out.withColumn("piece", F.col("piece").cast("int"))


class Lengths:
    """How many pieces of each length are left; lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.keys, most)
        return self.keys[i - 1] if i else None

    def smallest(self, k: int) -> int | None:
        """Sum of the k smallest pieces, or None if there are fewer."""
        total = 0
        for length in self.keys[:k]:
            n = min(k, self.n[length])
            total, k = total + n * length, k - n
            if not k:
                return total
        return None

    def best_two(self, room: int, floor: int = 0) -> int | None:
        """Largest sum within ``room`` of two pieces longer than ``floor``."""
        keys, best = self.keys, None
        i, j = bisect.bisect_right(keys, floor), len(keys) - 1
        while i <= j:
            s = keys[i] + keys[j]
            if s > room or (i == j and self.n[keys[i]] < 2):
                j -= 1
            else:
                best = s if best is None else max(best, s)
                i += 1
        return best


def dominating(left: Lengths, length: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that, with one piece of ``length`` (already taken out of ``left``),
    dominate every other set that holds it: some optimal packing has this set."""
    room = capacity - length
    one = left.largest(room)
    if one is None:
        return ()
    if one == room:
        return (one,)
    two = left.smallest(2)
    if two is None or two > room:
        return (one,)
    three = left.smallest(3)
    if three is not None and three <= room:
        return None
    pair = left.best_two(room)
    if pair is not None and pair <= one:
        return (one,)
    left.take(one, 1)
    other = left.largest(room - one)
    left.n[one] = left.n.get(one, 0) + 1
    if left.n[one] == 1:
        bisect.insort(left.keys, one)
    if other is not None and left.best_two(room, floor=other) is None:
        return (one, other)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset) rows that place every
    piece: dominance reduction to a fixpoint, then best fit decreasing."""
    left, rank, out, sequence = Lengths(counts), dict.fromkeys(counts, 0), [], 0

    def put(length: int, n: int, at: int, offset: int) -> None:
        out.append((length, rank[length], n, at, offset))
        rank[length] += n

    changed = True
    while changed:
        changed = False
        for length in sorted(left.n, reverse=True):
            while left.n.get(length):
                left.take(length, 1)
                mates = dominating(left, length, capacity)
                left.n[length] = left.n.get(length, 0) + 1
                if left.n[length] == 1:
                    bisect.insort(left.keys, length)
                if mates is None:
                    break
                # Taking pieces away leaves fewer alternatives, so the same set
                # dominates as long as its lengths are there in number.
                want = {x: (length, *mates).count(x) for x in (length, *mates)}
                n = min(left.n[x] // c for x, c in want.items())
                offset = 0
                for x in (length, *mates):
                    put(x, n, sequence, offset)
                    left.take(x, n)
                    offset += x
                sequence += n
                changed = True
    # Best fit decreasing on runs of sequences with equal room.
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    for length in sorted(left.n, reverse=True):
        n = left.n[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):  # new sequences: best fit fills each before the next
                per = capacity // length
                for many, each in ((n // per, per), (1, n % per)):
                    if many and each:
                        for j in range(each):
                            put(length, many, sequence, j * length)
                        if capacity - each * length:
                            _add(runs, rooms, capacity - each * length, (sequence, many))
                        sequence += many
                break
            room = rooms[i]
            first, many = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(i)
            k = min(n, many)
            if k < many:
                _add(runs, rooms, room, (first + k, many - k))
            put(length, k, first, capacity - room)
            if room - length:
                _add(runs, rooms, room - length, (first, k))
            n -= k
    return out


def _add(runs: dict, rooms: list, room: int, run: tuple[int, int]) -> None:
    if room not in runs:
        runs[room] = []
        bisect.insort(rooms, room)
    runs[room].append(run)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (id, piece, length, ...) with sequence_id and offset.

    Every piece gets a place; a sequence holds ``capacity`` tokens at most, from
    offset 0 on without gaps. Order within a length is by a hash of id, piece and ids.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity)
    spans = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first long, number long, at long, offset long")
    # All ranges of a length in one row, by first rank: at most ``capacity`` rows.
    spans = spans.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "number", "at", "offset"))).alias("spans"))
    order = F.xxhash64(F.col("id").cast("string"), "piece", "start", "ids_crc32")
    ranked = common.running(parts.filter(F.col("length").isNotNull()), "length", order, ["id", "piece", "ids_crc32"], F.lit(1), "rank")
    out = ranked.join(F.broadcast(spans), "length", "left")
    hit = F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["number"]))[0]
    out = out.withColumn("hit", hit)
    return out.withColumn("sequence_id", F.col("hit.at") + F.col("rank") - F.col("hit.first")).withColumn("offset", F.col("hit.offset")).drop("hit", "spans", "rank")


def _plans(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity)
        out = pd.DataFrame(rows, columns=["length", "first", "number", "at", "offset"])
        return out.assign(window=int(pdf["window"].iloc[0]), sequences=int((out["at"] + out["number"]).max()))

    return run


def placed(parts: DataFrame) -> DataFrame:
    """``parts`` of every row of a Parquet table, with ``position``: the number of the
    row in reading order, from ``file`` and ``row`` (its number in the file). Files
    are ordered by the number that Spark's writer gives them, then by name."""
    number = F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long")
    # One row per file is put in sequence.
    before = Window.orderBy(number.asc_nulls_last(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.groupBy("file").agg((F.max("row") + 1).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return parts.join(files, "file").withColumn("position", F.col("ahead") + F.col("row")).drop("ahead", "file", "row")


def pack_in_order(parts: DataFrame, capacity: int = CAPACITY, rows: int | None = None) -> DataFrame:
    """As ``pack``, in the order of ``parts``' column position.

    Each ``rows`` rows (ROWS) are a window that is packed alone; sequences are
    numbered by window, and pieces of a length are dealt to the window's
    sequences in order.
    """
    parts = parts.withColumn("window", F.floor(F.col("position") / (rows or ROWS)).cast("long"))
    counts = parts.groupBy("window", "length").agg(F.count("*").alias("n"))
    spans = common.saved(counts.groupBy("window").applyInPandas(_plans(capacity), "window long, length long, first long, number long, at long, offset long, sequences long"), "spans")
    # One row per window is put in sequence.
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spans.groupBy("window").agg(F.max("sequences").alias("n")).select("window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    spans = spans.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("first", "number", "at", "offset"))).alias("spans")).join(ahead, "window")
    order = Window.partitionBy("window", "length").orderBy("position", "piece")
    out = parts.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(spans, ["window", "length"])
    hit = F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["number"]))[0]
    out = out.withColumn("hit", hit)
    return out.withColumn("sequence_id", F.col("ahead") + F.col("hit.at") + F.col("rank") - F.col("hit.first")).withColumn("offset", F.col("hit.offset")).drop("hit", "spans", "rank", "window", "ahead")


def best_fit_packing(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (ids), sequence_id, offset.
    With ``in_order``, for ``docs`` as read from Parquet files, sequences follow the
    order of the rows in the files (see ``pack_in_order``).

    Documents longer than ``capacity`` tokens, however long, alone are cut. Null
    texts are empty: one piece with the end id. Repeated rows are packed each, in
    any order among themselves; null ids pass through; other columns are ignored;
    an empty table gives no rows.
    """
    carried = ()
    if in_order:
        meta, carried = docs.metadataColumn("_metadata"), ("file", "row")
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta["file_name"].alias("file"), meta["row_index"].alias("row"))
        id_col, text_col, name = "id", "text", id_col
    else:
        name = id_col
    parts = common.saved(pieces(docs, file, capacity, end_id, with_ids, id_col, text_col, carried), "pieces")
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["sequence_id", "offset"]
    packed = pack_in_order(placed(parts), capacity) if in_order else pack(parts, capacity)
    return packed.select(F.col("id").alias(name), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_best_fit_packing over the whole of ``documents``."""
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
