"""Fixtures of the training-data operators' tests."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def rows_of(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


#: Columns whose names the operators use inside.
EXTRA = "id string, row int, key string, n long, kept boolean, fp double, tile string, words int, held_out int, size int, rank string, spans int, lang2 string"


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    text = "the quick brown fox jumps over the lazy dog again and again until the night falls"
    texts = [None, "", "   \n\t ", text, text, text + " x", "word " * 4000, "é" * 5000, "a", "password = hunter2xyz!A9", None, "0123456789abcdef" * 3, "q" * 300_000]
    rows = [(i, t, ["en", None, "xx"][i % 3], ["s1", None, "s2", "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, text, "en", "s1", len(text)), (None, text, None, None, None), (None, None, None, None, None)]
    return [(*r, "x", 1, None, 2, True, None, "t", 3, 4, 5, "r", 6, None) for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


def held(doc_id, mod, is_):
    return zlib.crc32(str(doc_id).encode()) % mod == is_
