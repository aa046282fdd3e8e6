"""Operators 2 and 3 against SQL and brute force."""

import math
import os
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from helpers import odd_docs, odd_rows, rows_of, words
from oracle import compare, connection
from pyspark.sql import functions as F

from gatewise.llm import mixing, quality_rules


def test_mixing_over_documents(spark, sf_dir):
    mine, theirs = compare(mixing.query(spark, sf_dir), connection(sf_dir), mixing.ORACLE_SQL)
    assert mine == theirs


def earliest_deadline_first(parts, slots):
    """Slot by slot in whole numbers."""
    q, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(slots):
        deadline, s = min((-(-(done[s] + 1) * q // a), s) for s, a in parts.items() if done[s] * q // a <= t)
        assert t < deadline
        out.append((s, done[s], t))
        done[s] += 1
    return out


RNG = np.random.default_rng(5)
MIXES = {
    "one large": ({"a": 0.9, **{f"b{i}": 0.0125 for i in range(8)}}, 128),
    "equal": ({f"s{i:04}": 1 for i in range(1000)}, 1024),
    "light ones": ({"a": 1, "b": 2, "c": 1e-4, "d": 3e-4, "e": 0.003}, 64),
    "any": ({f"s{i}": float(x) for i, x in enumerate(RNG.random(12) ** 3 + 0.02)}, 64),
    "no light ones": ({f"s{i}": float(x) for i, x in enumerate(RNG.random(9) + 0.1)}, 64),
    "only one": ({"only": 2}, 16),
}


@pytest.mark.parametrize("name", MIXES)
def test_schedule_keeps_within_a_block(spark, monkeypatch, name):
    """No source is ever a block away from its target weight, over several ranges."""
    weights, slots = MIXES[name]
    monkeypatch.setattr(mixing, "SLOTS", slots)
    parts, total = mixing.parts(weights), sum(map(Fraction, weights.values()))
    q, n = sum(parts.values()), 3000
    for s, w in weights.items():
        assert abs(Fraction(parts[s], q) - Fraction(w) / total) < Fraction(1, 10**12)
    sources = spark.createDataFrame([(s, a, -(-n * a // q)) for s, a in parts.items()], "source string, a long, blocks long")
    laid = sorted(mixing.schedule(sources).collect(), key=lambda r: r["slot"])
    assert len({r["slot"] for r in laid}) == len(laid) == sum(-(-n * a // q) for a in parts.values())
    done = Counter()
    for r in laid:
        k, w = done[r["source"]], Fraction(weights[r["source"]]) / total
        assert r["block"] == k and r["release"] <= r["slot"] < r["deadline"]
        # The share is furthest off just before and after a block of the source.
        assert abs(k - w * r["slot"]) < 1 + Fraction(1, 10**6) and abs(k + 1 - w * (r["slot"] + 1)) < 1 + Fraction(1, 10**6)
        done[r["source"]] += 1
    if all(a * slots >= q for a in parts.values()):
        want = set(earliest_deadline_first(parts, laid[-1]["slot"] + 1))
        assert {(r["source"], r["block"], r["slot"]) for r in laid} <= want


def test_mixing_of_odd_rows(spark):
    got = mixing.mix_sources(odd_docs(spark), {"s1": 3, "s2": 1}, block=20).collect()
    assert len(got) == len(odd_rows())
    assert {r["slot"] is None for r in got if r["source"] == "unknown"} == {True}
    for s in ("s1", "s2"):
        at = 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: r["start"]):
            assert r["start"] == at and r["block"] == at // 20 and r["release"] <= r["slot"] < r["deadline"]
            at += r["size"]
    assert mixing.mix_sources(odd_docs(spark).limit(0)).count() == 0
    whole = mixing.mixed(odd_docs(spark), {"s1": 3, "s2": 1}, block=20)
    assert whole.columns == odd_docs(spark).columns and mixing.mixed(odd_docs(spark).limit(0)).count() == 0
    at = {(r["doc_id"], r["source"], r["start"]): r["slot"] for r in got}
    want = sorted(got, key=lambda r: (r["slot"] is None, r["slot"], r["source"], r["start"]))
    assert [r["doc_id"] for r in whole.collect()] == [r["doc_id"] for r in want] and len(at) == len(got)


def test_parts_are_exact():
    assert mixing.parts({"a": 0.5, "b": 0.25, "c": 0, "d": -1}) == {"a": 2, "b": 1}
    assert mixing.parts({}) == {} and sum(mixing.parts({str(i): 1 for i in range(600)}).values()) == 600
    tiny = mixing.parts({"a": 1.0, "b": 1e-30})
    assert tiny["b"] == 1 and tiny["a"] >= 1 << 52


def base(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_match_their_sql(spark):
    sf_dir = "/root/testdata/sf0.01"  # too few labels for a cutoff
    mine, theirs = compare(quality_rules.query(spark, sf_dir), connection(sf_dir), quality_rules.ORACLE_SQL)
    assert mine == theirs


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs some thousand labels")
def test_rules_match_their_sql_where_cutoffs_bite(spark):
    """With some thousand labels several rules reject texts that pass the base."""
    sf_dir = "/root/testdata/sf0.1"
    got = quality_rules.query(spark, sf_dir)
    mine, theirs = compare(got, connection(sf_dir), quality_rules.ORACLE_SQL)
    assert mine == theirs
    kinds = {r["failed_rules"] for r in got.filter("not base_failed and not kept").select("failed_rules").distinct().collect()}
    assert len(kinds) >= 2 and "" not in kinds


def test_rules_over_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in quality_rules.query(spark, sf_dir).collect()}
    docs = rows_of(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d["doc_id"]][c] for c in BASE) == base(d["text"])
    assert all(not (r["kept"] and r["base_failed"]) for r in got.values())


def test_rules_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in got) == sorted(base(r[1]) for r in odd_rows())
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0


@pytest.mark.parametrize("p", [0.004, 0.02, 0.3])
def test_binomial_tail(spark, p):
    cases = [(n, k) for n in (1, 10, 300, 5000) for k in range(0, 60) if k < n * p]
    cases += [(n, int(n * p * part)) for n in (1_000_000, 3_000_000) for part in (0.9, 0.99, 0.9999)]  # thousands of terms
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
        exact = math.fsum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(p) + (r["n"] - i) * math.log1p(-p)) for i in range(r["k"] + 1))
        assert r["t"] == pytest.approx(exact, rel=1e-8)


def test_cutoffs_limit_false_rejections(spark):
    """Good texts of a stratum have symbols in known numbers; bad ones have many."""
    rows = [(i, "word " * 20 + "# " * (1 if i % 500 == 0 else 0), "en") for i in range(3000)]
    rows += [(10_000 + i, "word " * 20 + " ".join(f"#$%{k}" for k in range(10)), "en") for i in range(300)]
    rows = [(i, " ".join(f"{w}{j}" if w == "word" else w for j, w in enumerate(t.split())), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, _, _ in rows], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    good = [r for r in got if r["doc_id"] < 10_000]
    assert sum(not r["kept"] for r in good) <= 0.02 * len(good)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 10_000)
    assert {tuple(r["failed_rules"]) for r in got if r["doc_id"] >= 10_000} <= {("symbols",), ("symbols", "word_length"), ("symbols", "repeats")}


def test_every_labelled_stratum_has_cutoffs(spark):
    """70 languages of equal size; in the last ones by name too, labels reject what is bad."""
    words = [f"w{i}" for i in range(20)]
    good, bad = " ".join(words), " ".join([*words, "#$%&|<>" * 6])
    docs = spark.range(70 * 2600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2600 < 2500, good).otherwise(bad).alias("text"), F.format_string("l%02d", (F.col("id") / 2600).cast("int")).alias("lang"))
    labels = docs.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    got = quality_rules.quality_rules(docs, labels).join(docs, "doc_id").groupBy("lang").agg(F.count_if("kept").alias("kept")).collect()
    assert len(got) == 70 and {r["kept"] for r in got} == {2500}
