"""Operators 11, 12 and 13 against brute force, round trips and the file's own tokenizer."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import lower, odd_docs, odd_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connection

from gatewise.llm import fill_in_middle, harmonic, spelling

# ---- operator 11 ----


def counted(rows, least=6, least_count=5, drop=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants(n, ratio=5):
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r["word"]: tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_documents(spark, sf_dir):
    n = counted((r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir))
    want = variants(n)
    assert any(w[1] for w in want.values())
    assert got_variants(spelling.query(spark, sf_dir)) == want


def test_variants_with_every_kind_of_edit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in ("letter", "aaaaaab", "banana", "état-étatéé", "mississippi", "zzzzzz"):
        base = base.replace("-", "")
        for k, copies in ((0, 40), (1, 7), (2, 5)):
            for _ in range(1 if k == 0 else 25):
                w = base
                for _ in range(k):
                    at = int(rng.integers(0, len(w) + 1))
                    c = "abézt"[int(rng.integers(0, 5))]
                    w = [w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]][int(rng.integers(0, 3))]
                rows.append((len(rows), " ".join([w] * copies)))
    chain = ["chainwordaaaa", "chainwordaaab", "chainwordaabb", "chainwordabbb", "chainwordbbbb"]
    rows += [(1000 + i, " ".join([w.upper() if i % 2 else w] * 5 * 6**i)) for i, w in enumerate(chain)]
    want = variants(counted(rows))
    assert want[chain[0]][2] == chain[-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_variants(spelling.spelling_variants(docs)) == want
    assert got_variants(spelling.spelling_variants(docs.repartition(7), drop=3)) == variants(counted(rows, drop=3))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=60))
def test_pairs_of_short_words(spark, found):
    rows = [(i, w) for i, w in enumerate(found)]
    want = variants(counted(rows, 1, 1, 10**9), 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_variants(spelling.spelling_variants(docs, 1, 1, 2, 10**9)) == want


def test_variants_of_odd_rows(spark):
    docs = odd_docs(spark)
    long_word = "q" * 300_000
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got_variants(spelling.spelling_variants(docs)) == variants(counted(rows))
    more = [(i, long_word[: 300_000 - (i == 9)]) for i in range(10)] * 5
    got = got_variants(spelling.spelling_variants(spark.createDataFrame(more, "doc_id long, text string")))
    want = counted(more)
    assert {w: v[3] for w, v in got.items()} == want
    assert {v[4] for v in got.values()} == {1}
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.filter("text is null")).count() == 0


# ---- operator 12 ----


def arranged(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    key = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, chars = "plain", text, (None, None)
    else:
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "spm" if h[3] % 100 < 80 else "psm"
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        chars = (len(p), len(m))
    return (doc_id, n, form, *chars, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_arrangements_of_documents(spark, sf_dir):
    got = fill_in_middle.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = Counter(arranged(r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, got.collect())) == want
    mine, theirs = compare(got, connection(sf_dir), fill_in_middle.ORACLE_SQL)
    assert mine == theirs


def test_arrangements_of_odd_rows(spark, tmp_path):
    texts = ["a <P> b", "x <S", "<M", "<", "a<S >b", "é 🙂🙂 \t\n b", "  ", " a ", "<<S>>", "P> S> M>", "<P <S <M " * 50]
    odd = odd_docs(spark)
    extra = spark.createDataFrame([(100 * k + i, t) for k in range(1, 30) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, fill_in_middle.query(spark, str(tmp_path)).collect())) == Counter(arranged(*r) for r in rows)
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    out = fill_in_middle.fill_in_middle(docs).filter("form <> 'plain'").collect()
    assert out and all(r["prefix"] + r["middle"] + r["suffix"] in {t or "" for _, t in rows} for r in out)


# ---- operator 13 ----

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_sequences(rows, got, capacity):
    """Tokens of padding and of all sequences."""
    slow = tokenizers.Tokenizer.from_file(WORDS)
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    left = defaultdict(Counter)
    for g in got:
        left[g["doc_id"], g["doc_tokens"]][g["start"], g["length"], g["ids_crc32"]] += 1
    for doc_id, texts in ids.items():
        for x in texts:
            found, at = left[doc_id, len(x)], 0
            while at < len(x):
                part = next(p for p, n in found.items() if n and p[0] == at and zlib.crc32(x[at : at + p[1]].tobytes()) == p[2])
                found[part] -= 1
                at += part[1]
            assert at == len(x)
    assert not any(n for found in left.values() for n in found.values())
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding, len(sequences)


def test_sequences_of_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir)]
    got = harmonic.query(spark, sf_dir).collect()
    padding, n = check_sequences(rows, got, 4096)
    assert padding <= 0.01 * sum(g["length"] for g in got) + 4096, (padding, n)


@pytest.mark.parametrize("capacity", [4096, 12])
def test_sequences_of_odd_rows(spark, capacity, monkeypatch):
    monkeypatch.setattr(harmonic, "SEQUENCES", 2)
    docs = odd_docs(spark)
    got = harmonic.harmonic_packing(docs, WORDS, capacity).collect()
    check_sequences([(r[0], r[1]) for r in odd_rows()], got, capacity)
    assert harmonic.harmonic_packing(docs.limit(0), WORDS, capacity).count() == 0
    with_ids = harmonic.harmonic_packing(docs, WORDS, capacity, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_cuts_end_near_reciprocal_shares():
    for capacity in (12, 100, 4096):
        for n in [*range(1, capacity + 1), 3 * capacity + 7]:
            parts = harmonic.cuts(n, capacity)
            assert sum(parts) == n and len(parts) <= n // capacity + 5
            for p in parts:
                k = capacity // p
                assert p == capacity // k or k * p >= capacity * (1 - harmonic.SLACK)


def test_full_sequences_hold_a_fixed_number_of_pieces(spark):
    parts = spark.createDataFrame([(i, 0, 7 if i % 3 else 5, i, 9, i) for i in range(5000)], "id long, start long, length long, ids_crc32 long, doc_tokens long, place long")
    got = harmonic.pack(parts, 15).collect()
    full = defaultdict(list)
    for g in got:
        if g["sequence_id"] < harmonic.LEFT_OVER:
            full[g["sequence_id"]].append(g["length"])
    assert {(len(x), *set(x)) for x in full.values()} == {(2, 7), (3, 5)}
    assert sum(map(len, full.values())) >= 4990
    assert len(got) == 5000
