"""Operators 1 and 10 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import lower, odd_docs, odd_rows, rows_of, words
from oracle import compare, connection

from pyspark.sql import functions as F

from gatewise.llm import common, exact_dedup, simhash


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    """Representative of each fingerprint by all pairs."""
    fps, parent = sorted(set(fps)), {}
    arr = np.array(fps, np.uint64)

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x in fps:
        for y in arr[np.bitwise_count(arr ^ np.uint64(x)) <= radius].tolist():
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def check_simhash(rows, got):
    fps = [fingerprint(r[1]) for r in rows]
    root, least = classes(fps), {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = sorted((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps) if r[0] is not None)
    assert sorted((g["doc_id"], g["fingerprint"], g["component_id"]) for g in got if g["doc_id"] is not None) == want
    assert len(got) == len(rows)


def test_simhash_over_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir)]
    check_simhash(rows, simhash.query(spark, sf_dir).collect())


def test_simhash_of_odd_rows(spark):
    check_simhash(odd_rows(), simhash.simhash_dedup(odd_docs(spark)).collect())
    assert simhash.simhash_dedup(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_of_clustered_fingerprints(spark, monkeypatch, tile):
    """Also where buckets are so large that they are split in tiles by bit counts."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    edges = simhash.near_links(df).collect()
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e["a"]), find(e["b"])
        parent[max(a, b)] = min(a, b)
    want = classes([f % (1 << 64) for f in fps])
    mine, theirs = defaultdict(set), defaultdict(set)
    for f in fps:
        mine[find(f)].add(f)
        theirs[want[f % (1 << 64)]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def check_exact(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for g in got:
        kept[g["text_sha256"]] += g["kept"]
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        largest = max((i for i in ids if i is not None), default=None)
        mine = [g for g in got if g["text_sha256"] == sha]
        assert sorted((g["doc_id"] for g in mine), key=str) == sorted(ids, key=str)
        assert {(g["keep_id"], g["group_size"]) for g in mine} == {(largest, len(ids))}
        assert kept[sha] == 1


def test_exact_over_documents(spark, sf_dir):
    mine, theirs = compare(exact_dedup.query(spark, sf_dir), connection(sf_dir), exact_dedup.ORACLE_SQL)
    assert mine == theirs


@pytest.mark.parametrize("moduli,huge", [(exact_dedup.MODULI, exact_dedup.HUGE), (exact_dedup.MODULI, 7000), (((2, 1), (3, 1)), exact_dedup.HUGE), (((2, 1), (3, 1)), 1000)])
def test_exact_of_odd_rows(spark, moduli, huge):
    """Pieces of huge texts, and fingerprints that collide, change nothing."""
    rows = odd_rows() + [(100 + i, t, *[None] * 16) for i, t in enumerate(("ab", "ba", "aab", "aba", "\0a", "a\0"))]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    check_exact(rows, exact_dedup.exact_dedup(docs, moduli=moduli, huge=huge).collect())


def test_fingerprints_compose():
    data = np.frombuffer(np.random.default_rng(1).bytes(300_000), np.uint8)
    for mod, base in exact_dedup.MODULI:
        whole, table = 0, {}
        for b in data.tolist():
            whole = (whole * base + b + 1) % mod
        assert exact_dedup.fingerprint(data, base, mod, table) == whole
        a, b = data[:100_001], data[100_001:]
        parts = exact_dedup.fingerprint(a, base, mod, table) * pow(base, len(b), mod) + exact_dedup.fingerprint(b, base, mod, table)
        assert parts % mod == whole


def test_exact_of_an_empty_table(spark):
    assert exact_dedup.exact_dedup(odd_docs(spark).limit(0)).count() == 0


def test_rows_stay_whole(spark):
    """One row of each text, and of each class, with all its columns."""
    docs = odd_docs(spark)
    rows = odd_rows()
    exact = exact_dedup.without_copies(docs)
    assert exact.columns == docs.columns and not {repr(tuple(r)) for r in exact.collect()} - {repr(tuple(r)) for r in docs.collect()}
    assert sorted(r["text"] or "" for r in exact.collect()) == sorted({r[1] or "" for r in rows})
    near = simhash.without_near_copies(docs)
    assert near.columns == docs.columns
    fps = [fingerprint(r[1]) for r in rows]
    root, least = classes(fps), {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(least.values()) and len(least) == len(set(root.values()))
    assert exact_dedup.without_copies(docs.limit(0)).count() == simhash.without_near_copies(docs.limit(0)).count() == 0


def test_repeat_filters_of_any_size(spark, monkeypatch):
    """Also where the filter is full, no key with enough rows is missed."""
    keys = spark.range(3000).select((F.col("id") % 2500 * 7919).alias("key")).cache()
    for most in (1, 1 << 21):
        monkeypatch.setattr(common, "LEAST_WORDS", 1)
        monkeypatch.setattr(common, "MOST_WORDS", most)
        found = common.repeat_filter(keys, F.col("key"), 2)
        assert found.size <= most or most == 1
        hit = {r["key"] for r in common.flagged(keys, found, F.col("key"), "hit").filter("hit").collect()}
        assert hit >= {i * 7919 for i in range(500)}
