"""Operators 4, 5 and 9: base scores by brute force, models by held-out quality."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import held, lower, odd_docs, odd_rows, rows_of, words
from pyspark.sql import functions as F

from gatewise.llm import common, language_id, lm_scoring, quality_classifier


def base_scores(rows, out):
    """n_tokens, n_known, train_tokens and base score of every row."""
    counts = Counter()
    for r in rows:
        if not out(r[0]):
            counts.update([*words(lower(r[1])), "<end>"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = [*words(lower(r[1])), "<end>"]
        yield r[0], len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)


def check_lm(rows, got, out):
    want = sorted(base_scores(rows, out), key=str)
    mine = sorted(((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"]) for g in got), key=str)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


def test_lm_over_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir)]
    got = lm_scoring.query(spark, sf_dir).collect()
    check_lm(rows, got, lambda i: held(i, 7, 2))
    assert all(g["held_out"] == held(g["doc_id"], 7, 2) for g in got)
    out = [g for g in got if g["held_out"]]
    assert all(g["score"] <= 0 and math.isfinite(g["score"]) for g in got)
    bits = -sum(g["score"] for g in out) / math.log10(2) / sum(g["n_bytes"] for g in out)
    base = -sum(g["base_score"] for g in out) / math.log10(2) / sum(g["n_bytes"] for g in out)
    assert bits < 3.0 and bits < base


def test_lm_on_held_out_texts(spark):
    got = [g for g in lm_scoring.query(spark, "/root/testdata/sf0.01").collect() if g["held_out"]]
    n = sum(g["n_bytes"] for g in got)
    bits, base = (-sum(g[c] for g in got) / math.log10(2) / n for c in ("score", "base_score"))
    assert bits < 2.05 < 2.1 < base


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_lm_of_odd_rows(spark, monkeypatch, most):
    """Also where nearly all words are joined instead of broadcast."""
    monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (most,))
    rows = odd_rows()
    got = lm_scoring.lm_scores(odd_docs(spark), F.lit(False)).collect()
    check_lm(rows, got, lambda i: False)
    assert lm_scoring.lm_scores(odd_docs(spark).limit(0), F.lit(False)).count() == 0


def follows(raw, after):
    return raw[after + 1 : len(raw) - 1][: lm_scoring.FOLLOWING]


def pairs_of(raw):
    """(pair of words, place after it, whether it is looked up) of a padded text."""
    data = np.frombuffer(raw[4:-1], np.uint8)
    places, keys, _ = lm_scoring.word_pairs(*lm_scoring.padded(data, np.array([0, len(data)])))
    hashed = dict(zip(places.tolist(), lm_scoring.looked_up(keys).tolist()))
    out, before, first = [], None, None
    for i, b in enumerate(raw):
        if b in b"\0\t\n\v\f\r ":
            if first is not None:
                out.append(((before, raw[first:i]), i, hashed.pop(i)))
                before, first = raw[first:i], None
        elif first is None:
            first = i
    assert not hashed
    return out


def slow_model(texts):
    """Counts by whole context, and what follows pairs of words, in plain Python."""
    counts, after, slots = {}, {}, {}
    for text in texts:
        raw = b"\0" * 4 + text + b"\0"
        data = np.frombuffer(text, np.uint8)
        buf, starts, lens = lm_scoring.padded(data, np.array([0, len(data)]))
        at, h = lm_scoring._inside(starts, lens), lm_scoring.words_so_far(buf)[0]
        full, slot = lm_scoring.full_contexts(buf, h, at), lm_scoring.contexts(buf, lm_scoring.word_slots(h), at)
        for i in range(4, len(raw)):
            for k, c in enumerate(slow_contexts(raw, i)):
                counts.setdefault(c, Counter())[raw[i]] += 1
                slots[c] = (k, int(slot[k][i - 4])), int(full[k][i - 4])
    # A slot is its most frequent context's.
    first = {}
    for c, (slot, full) in slots.items():
        first[slot] = max(first.get(slot, (0, 0, None)), (counts[c].total(), full, c))
    counts = {c: counts[c] for _, _, c in first.values()}
    for text in texts:
        raw = b"\0" * 4 + text + b"\0"
        for key, at, _ in pairs_of(raw):
            after.setdefault(key, []).append(follows(raw, at))
    return counts, {k: (os.path.commonprefix(v), len(v)) for k, v in after.items()}


def word_start(raw, i):
    while raw[i - 1] not in b"\0\t\n\v\f\r " and i > 4:
        i -= 1
    return i


def slow_contexts(raw, i):
    return [(k, raw[i - k : i]) if k else (0, raw[word_start(raw, i) : i]) for k, _ in lm_scoring.ORDERS]


def slow_bits(model, text, own):
    """The cost of one text, bit by bit."""
    counts, after = model
    raw = b"\0" * 4 + text + b"\0"
    expected, last = [None] * len(raw), {}
    for key, at, asked in pairs_of(raw):
        guess = follows(raw, last[key]) if key in last else after[key][0] if asked and key in after and not (own and after[key][1] == 1) else b""
        for k, g in enumerate(guess):
            if g == 0 or at + 1 + k >= len(raw) - 1:
                break
            expected[at + 1 + k] = g
            if raw[at + 1 + k] != g:
                break
        last[key] = at
    n = len(lm_scoring.ORDERS) + 1
    w, step, total = np.full((8, 2, n), lm_scoring.START), np.zeros((8, 2, n)), 0.0
    for i in range(4, len(raw)):
        if (i - 4) % lm_scoring.BLOCK == 0:
            w, step = w + step, np.zeros_like(w)
        found = [counts.get(c, Counter()) for c in slow_contexts(raw, i)]
        gate, low = int(i - word_start(raw, i) >= lm_scoring.DEEP), 0
        for j in range(8):
            half = 1 << (7 - j)
            st = []
            for c in found:
                zero, one = (sum(c[b] for b in range(low + x * half, low + (x + 1) * half)) for x in (0, 1))
                st.append(float(np.clip(np.rint(math.log((one + lm_scoring.PRIOR) / (zero + lm_scoring.PRIOR)) * 10), -127, 127)) / 10)
            g = expected[i]
            on = g is not None and low <= g < low + 2 * half
            st.append((1 if g & half else -1) * lm_scoring.SURE / 10 if on else 0.0)
            bit = raw[i] >> (7 - j) & 1
            p = 1 / (1 + math.exp(-float(w[j, gate] @ st)))
            total -= math.log2(p if bit else 1 - p)
            step[j, gate] += lm_scoring.RATE * (bit - p) * np.array(st)
            low += bit * half
    return total


def test_lm_scores_match_a_plain_loop(spark):
    """Counts, continuations and mixing in plain Python give the query's scores."""
    line = "a passage of some words that is found in two texts and goes on for a while, é and ü too, " + " ".join(f"w{i}x" for i in range(120))
    texts = ["", "a b", "some words and more words " * 8, "x" * 300, line, "first " + line + " then", line[:60] + "other", "q\0r s\tt\n" * 6, None, line]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, F.col("doc_id") % 4 == 1).collect()}
    assert sum(asked for _, _, asked in pairs_of(b"\0" * 4 + line.encode() + b"\0")) > 3
    model = slow_model([(t or "").encode() for i, t in rows if i % 4 != 1])
    for i, t in rows:
        want = slow_bits(model, (t or "").encode(), i % 4 != 1)
        assert got[i]["score"] == pytest.approx(-want * math.log10(2), rel=2e-3), i
        assert got[i]["bits_per_byte"] == pytest.approx(want / max(1, len((t or "").encode())), rel=2e-3)


def test_lm_texts_are_scored_alone():
    """A text's cost is the same in any company, and over several blocks of texts."""
    rng = np.random.default_rng(3)
    tables = [rng.integers(-60, 60, 1 << (b + 8)).astype(np.int8) for _, b in lm_scoring.ORDERS]
    texts = [b"", b"a b", b"some words and more words " * 30, b"x" * 700, "é and ü".encode() * 50, *(bytes(rng.integers(32, 127, int(n)).tolist()) for n in rng.integers(0, 200, 400))]
    mixer = lm_scoring.Mixer(lm_scoring.laid_out(tables))
    got = mixer.run(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for g, t in list(zip(got, texts))[::7]:
        alone = mixer.run(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert alone[0] == pytest.approx(g, rel=1e-4)


def test_language_over_documents(spark, sf_dir):
    rows = {r["doc_id"]: r for r in rows_of(spark, sf_dir)}
    got = language_id.query(spark, sf_dir).collect()
    assert len(got) == len(rows)
    out = [g for g in got if g["held_out"] and rows[g["doc_id"]]["lang"] and g["lang_pred"] != "und"]
    assert np.mean([g["lang_pred"] == rows[g["doc_id"]]["lang"] for g in out]) >= 0.9
    assert all(g["held_out"] == held(g["doc_id"], 5, 0) and 0 <= g["score"] <= 1 for g in got)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = language_id.language_id(docs, F.lit(False)).collect()
    rows = odd_rows()
    assert sorted(str(g["doc_id"]) for g in got) == sorted(str(r[0]) for r in rows)
    und = [r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")]
    assert sorted((g["doc_id"] for g in got if g["lang_pred"] == "und"), key=str) == sorted(und, key=str)
    assert language_id.language_id(docs.limit(0), F.lit(False)).count() == 0
    assert {g["lang_pred"] for g in language_id.language_id(docs, F.lit(True)).collect()} == {"und"}


def test_grams_match_a_plain_loop():
    for texts in (["", "ab", "é日本"], ["x"], []):
        if not texts:
            continue
        bucket, row = language_id.grams(texts)
        assert len(row) == sum(map(len, texts)) and bucket.shape == (3, len(row))
        alone = [language_id.grams([t])[0] for t in texts]
        assert np.array_equal(bucket, np.concatenate(alone, axis=1))


def graded_words(spark, n=900):
    """Texts whose words tell their grade."""
    rng = np.random.default_rng(4)
    pools = [[f"bad{i}" for i in range(30)], [f"mid{i}" for i in range(30)], [f"good{i}" for i in range(30)]]
    common_words = [f"the{i}" for i in range(50)]
    rows = []
    for i in range(n):
        g = i % 3
        rows.append((i, " ".join(rng.permutation([*rng.choice(pools[g], 6), *rng.choice(common_words, 20)]).tolist()), g))
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_classifier_orders_grades(spark):
    rows = graded_words(spark)
    train = rows.filter("doc_id % 5 <> 0").select("doc_id", "grade")
    got = quality_classifier.quality_classifier(rows, train).join(rows.select("doc_id", "grade"), "doc_id").filter("doc_id % 5 = 0").collect()
    mean = [np.mean([g["expected_grade"] for g in got if g["grade"] == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and mean[2] - mean[0] > 1
    assert np.mean([(g["p_tail"] > 0.5) == (g["grade"] == 2) for g in got]) > 0.95
    kept = quality_classifier.good_rows(rows, train)
    assert kept.columns == rows.columns
    verdict = {g["doc_id"] for g in quality_classifier.quality_classifier(rows, train).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict


def test_classifier_of_odd_rows(spark):
    docs = odd_docs(spark)
    grades = spark.createDataFrame([(0, 2), (3, 2), (6, 0), (7, 1), (None, 0), (4, None), (999, 0)], "doc_id long, grade int")
    got = quality_classifier.quality_classifier(docs, grades).collect()
    assert len(got) == len(odd_rows()) and all(0 <= g["p_tail"] <= 1 for g in got)
    assert quality_classifier.quality_classifier(docs, grades.limit(0)).filter("kept").count() == len(odd_rows())
    assert quality_classifier.quality_classifier(docs, grades.filter("grade = 0")).filter("kept").count() == 0
    assert quality_classifier.quality_classifier(docs.limit(0), grades).count() == 0


def test_classifier_over_documents(spark, sf_dir):
    labels = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "labels")}
    got = quality_classifier.query(spark, sf_dir).collect()
    assert len(got) == len(rows_of(spark, sf_dir))
    seen = [(g["kept"], labels[g["doc_id"]]) for g in got if g["doc_id"] in labels]
    good = [k for k, lab in seen if lab["toxic"] == 0 and lab["quality"] == 1]
    assert np.mean(good) > 0.95


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs some thousand labels")
def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality_classifier.quality_classifier(docs, quality_classifier.graded(labels.filter("doc_id % 3 <> 0")))
    seen = got.join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    share = lambda test: np.mean([r["kept"] for r in seen if test(r)])
    assert share(lambda r: r["toxic"] == 1) < 0.12
    assert share(lambda r: r["toxic"] == 0 and r["quality"] == 1) > 0.98


def test_word_hashes_are_those_of_words():
    text = b"one two  one\ttwo three " + bytes(range(33, 127))
    data, offs = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    starts, ends, row = common.words_of(data, offs)
    got = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert got == text.split() * 2 and row.tolist() == [0] * len(text.split()) + [1] * len(text.split())
    h = common.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(got)) and h[0] == h[2]


def test_lm_contexts_are_counted_apart(spark):
    """Each text's predictions come from the counts of its whole contexts."""
    rng = np.random.default_rng(8)
    texts = ["".join(chr(c) for c in rng.integers(33, 127, 400)) for _ in range(60)]
    counts = pa.Table.from_batches(list(lm_scoring._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))))
    held = lm_scoring.context_tables(spark.createDataFrame(counts.to_pandas().groupby(["kind", "key"], as_index=False).sum(), "kind int, key long, n long"))
    mixer = lm_scoring.Mixer(*held)
    data, offs = common.utf8(pa.array(texts))
    want = {}
    for text in texts:
        raw = b"\0" * 4 + text.encode() + b"\0"
        for i in range(4, len(raw)):
            for kind, k in enumerate((2, 4), 1):
                want.setdefault((kind, raw[i - k : i]), Counter())[raw[i]] += 1
    buf, starts, lens = lm_scoring.padded(data, offs)
    at = lm_scoring._inside(starts, lens)
    full = lm_scoring.full_contexts(buf, lm_scoring.words_so_far(buf)[0], at)
    slots = lm_scoring.contexts(buf, lm_scoring.word_contexts(buf)[0], at)
    for kind, k in enumerate((2, 4), 1):
        for p in rng.choice(len(at), 60, replace=False):
            count = np.zeros((1, 256))
            for byte, n in want[kind, bytes(buf[at[p] - k : at[p]])].items():
                count[0, byte] = n
            slot, key = slots[kind - 1][p] + mixer.first[kind - 1], full[kind - 1][p : p + 1]
            if held[1][slot] == key[0]:
                assert held[0][slot * 17 : slot * 17 + 17].tobytes() == lm_scoring.laid_out([lm_scoring.stretched(count)])[:17].tobytes()


class PlainFtrl:
    """Follow-the-regularised-leader, weight by weight."""

    def __init__(self, alpha, l1, l2, beta=1.0):
        self.z, self.n, self.set = {}, {}, (alpha, l1, l2, beta)

    def weight(self, k):
        (alpha, l1, l2, beta), z = self.set, self.z.get(k, 0.0)
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(self.n.get(k, 0.0))) / alpha + l2)

    def update(self, k, g):
        n, w = self.n.get(k, 0.0), self.weight(k)
        self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.set[0] * w
        self.n[k] = n + g * g


def spelled(n, kinds, seed):
    """Texts of random words over a few letters for each kind."""
    rng, out = np.random.default_rng(seed), []
    letters = ["abcde", "efghi", "ijkla"]
    for i in range(n):
        words_ = ["".join(rng.choice(list(letters[i % kinds]), 4)) for _ in range(8)]
        out.append((i, " ".join(words_), "xyz"[i % kinds]))
    return out


def test_language_matches_a_plain_loop(spark):
    """Document frequencies, TF-IDF, training, means of shards, temperature and probabilities, all in plain Python."""
    rows = spelled(90, 3, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = F.col("doc_id") % 6 == 0
    settings = {"shards": 2, "epochs": 2, "alpha": 0.5, "l1": 0.01, "l2": 0.01}
    got = {r["doc_id"]: r for r in language_id.language_id(docs, out, **settings).collect()}
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")).alias("o")).collect()}

    def counts(text):
        return Counter(int(b) for b in language_id.grams([text.lower()])[0].ravel())

    train, df = [r for r in rows if r[0] % 6], Counter()
    for r in train:
        df.update(counts(r[1]).keys())
    idf = {k: math.log((1 + len(train)) / (1 + v)) + 0.1 for k, v in df.items()}
    none = math.log(1 + len(train)) + 0.1

    def features(text):
        return {**{k: c * idf.get(k, none) * language_id.SCALE / len(text) for k, c in counts(text).items()}, "bias": 1.0}

    langs, weights = ["x", "y", "z"], Counter()
    for shard in range(2):
        own = sorted((order[r[0]], r) for r in train if order[r[0]] % 5 and (order[r[0]] >> 8) % 2 == shard)
        model = PlainFtrl(settings["alpha"], settings["l1"], settings["l2"])
        for _ in range(2):
            for _, r in own:
                x = features(r[1])
                s = [sum(model.weight((k, j)) * v for k, v in x.items()) for j in range(3)]
                p = np.exp(s - np.max(s)) / np.exp(s - np.max(s)).sum()
                for j in range(3):
                    for k, v in x.items():
                        model.update((k, j), v * (p[j] - (langs[j] == r[2])))
        for k in model.z:
            weights[k] += model.weight(k) / 2

    def logits(text):
        return np.array([sum(weights[k, j] * v for k, v in features(text).items()) for j in range(3)])

    apart = [r for r in train if order[r[0]] % 5 == 0]
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.mean([np.log(language_id.softmax(logits(r[1]) / t)[langs.index(r[2])] + 1e-12) for r in apart]) for t in grid]
    heat = grid[int(np.argmin(loss))]
    for i, text, _ in rows:
        p = language_id.softmax(logits(text) / heat)
        assert got[i]["lang_pred"] == langs[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), rel=1e-6)


def test_classifier_matches_a_plain_loop(spark):
    """Features, ordinal training and probabilities in plain Python."""
    rows = [(i, t, "xyz".index(k)) for i, t, k in spelled(60, 3, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    settings = {"epochs": 2, "alpha": 0.3, "l1": 0.5, "l2": 0.1}
    train = docs.filter("doc_id % 4 <> 0").select("doc_id", "grade")
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs, train, **settings).collect()}
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")).alias("o")).collect()}

    def features(text):
        data = np.frombuffer(text.encode(), np.uint8)
        found = {int(b): 1.0 for w in text.split() for b in quality_classifier.word_features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1]}
        shares = quality_classifier.class_shares(data, np.array([0, len(data)]))[0]
        return {**found, **{("class", k): float(np.float32(v)) for k, v in enumerate(shares) if v}}

    own = [r for _, r in sorted((order[r[0]], r) for r in rows if r[0] % 4)]
    share = np.bincount([r[2] for r in own]) / len(own)
    above = [share[1] + share[2], share[2]]
    t = [math.log((1 - a) / a) + 1e-6 * k for k, a in enumerate(above)]
    model, sigmoid = PlainFtrl(settings["alpha"], settings["l1"], settings["l2"]), lambda v: 1 / (1 + math.exp(-v))
    for epoch in range(2):
        for _, text, y in own:
            x = features(text)
            s = sum(model.weight(k) * v for k, v in x.items())
            p = [sigmoid(s - c) for c in t]
            over, under = (p[y - 1] if y else 1.0), (p[y] if y < 2 else 0.0)
            d = (over * (1 - over) - under * (1 - under)) / (over - under)
            rate = 0.05 / (1 + epoch)
            if y:
                t[y - 1] -= rate * over * (1 - over) / (over - under)
            if y < 2:
                t[y] += rate * under * (1 - under) / (over - under)
            t[1] = max(t)
            for k, v in x.items():
                model.update(k, -d * v)
    for i, text, _ in rows:
        s = sum(model.weight(k) * v for k, v in features(text).items())
        p = [sigmoid(s - c) for c in t]
        assert got[i]["p_tail"] == pytest.approx(p[1], rel=1e-4) and got[i]["expected_grade"] == pytest.approx(sum(p), rel=1e-4)


def test_lm_follows_every_pair_of_words():
    """No pair of words is left out, and what follows is whole up to where texts part."""
    texts = [" ".join(f"w{i}" for i in range(200)), "w0 w1 w2 other", "a b \0\0c d"]
    found = pa.Table.from_batches(list(lm_scoring._pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))).to_pydict()
    want = {}
    for text in texts:
        raw = b"\0" * 4 + text.encode() + b"\0"
        for key, at, _ in pairs_of(raw):
            want.setdefault(key, []).append(follows(raw, at))
    assert len(found["key"]) == len(want) > 200
    plain = lambda b: b.rstrip(b"\0")
    assert sorted(zip(found["n"], map(plain, found["same"]))) == sorted((len(v), plain(os.path.commonprefix(v))) for v in want.values())
    rows = np.array([[0] * lm_scoring.FOLLOWING, [0, 7] + [0] * (lm_scoring.FOLLOWING - 2), [1] * lm_scoring.FOLLOWING], np.uint8)
    assert (lm_scoring.filled(lm_scoring.trimmed(rows)) == rows).all()


def test_lm_tables_are_sent_out_small():
    """As the check counts what executors keep on disk of a broadcast."""
    table = np.zeros(17 << 14, np.complex128)
    table[::1000] = 1
    taken = np.arange(1 << 14, dtype=np.uint64)
    sent = lm_scoring.packed(table, taken)
    assert sum(map(len, sent)) < table.nbytes / 20
    for a, b in zip(lm_scoring.unpacked(*sent), (table, taken)):
        assert (a == b).all() and a.dtype == b.dtype


def test_tidy_tables_leave_no_shuffle_files(spark):
    from gatewise.operators import store

    before = spark.conf.get(store.CLEANUP, None)
    saved = store.saved(spark.range(1000).repartition(3), "tidy", tidy=True)
    assert saved.count() == 1000 and spark.conf.get(store.CLEANUP, None) == before


def test_lm_sends_out_the_pairs_that_are_told_alone(spark, monkeypatch):
    """What follows a pair of words leaves its task only if some text is told it, in any number of buckets and parts."""
    line = " ".join(f"v{i}" for i in range(60))
    texts = [" ".join(f"w{i}" for i in range(2000)), line, "x " + line, "y w5 w6 w7", "w8 w9 other w8 w9 more", "u0 u1 u2 u3", None]
    rows = [(i, t or "", i == 3) for i, t in enumerate(texts)]
    src = spark.createDataFrame(rows, "id long, text string, held_out boolean")
    found, asked = {}, set()
    for i, t, out in rows:
        raw = b"\0" * 4 + t.encode() + b"\0"
        data = np.frombuffer(t.encode(), np.uint8)
        places, keys, _ = lm_scoring.word_pairs(*lm_scoring.padded(data, np.array([0, len(data)])))
        asked |= set(keys.tolist()) if out else set()
        for k, at in zip(keys.tolist(), places.tolist()):
            if not out:
                found.setdefault(k, []).append(follows(raw, at))
    want = {k: (len(v), os.path.commonprefix(v)) for k, v in found.items() if os.path.commonprefix(v) and (len(v) > 1 or k in asked)}
    assert 50 < len(want) < len(found) / 20
    scores = []
    for bucket, part in ((1 << 22, 1 << 11), (1 << 10, 3)):
        monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
        monkeypatch.setattr(lm_scoring, "PART", part)
        live = lm_scoring.live_pairs(src)
        assert len(live) == (1 if part > 3 else 6)
        sent = lm_scoring.continuations(src.filter("not held_out").select("text"), live).collect()
        got = {r["key"]: (r["n"], bytes(r["same"])) for r in sent}
        assert len(got) == len(sent) < len(want) + 20 and want.items() <= got.items()
        scores.append({r["id"]: r["score"] for r in lm_scoring.lm_scores(src, F.col("held_out"), "id").collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_deleted_tables_are_gone(spark):
    from gatewise.operators import store

    saved = store.saved(spark.range(10), "gone")
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in saved.inputFiles()}
    assert os.path.isdir("/" + path.lstrip("/"))
    store.deleted(saved)
    assert not os.path.exists("/" + path.lstrip("/"))


def test_lm_texts_follow_each_other_in_step(monkeypatch):
    """Short texts take the places of those that have ended beside a long one."""
    rng = np.random.default_rng(5)
    tables = [rng.integers(-60, 60, 1 << (b + 8)).astype(np.int8) for _, b in lm_scoring.ORDERS]
    mixer, calls = lm_scoring.Mixer(lm_scoring.laid_out(tables)), []
    monkeypatch.setattr(lm_scoring, "TOGETHER", 8)
    block = lm_scoring.Mixer._block
    monkeypatch.setattr(lm_scoring.Mixer, "_block", lambda self, *a: calls.append(1) or block(self, *a))
    texts = [bytes(rng.integers(97, 123, n * lm_scoring.BLOCK - 1).tolist()) for n in (30, *[3] * 70)]
    got = mixer.run(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert len(calls) <= 30 + 3 and (got > 0).all()  # 240 blocks in 8 places


def test_lm_counts_leave_their_tasks_by_part(spark):
    """Counts go out as a row for each part, and merge to those of all texts."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 400)) for _ in range(40)]
    halves = [[pa.RecordBatch.from_arrays([pa.array(texts[i::2])], names=["text"])] for i in range(2)]
    dealt = [pa.Table.from_batches(list(lm_scoring._counted_parts(iter(h)))) for h in halves]
    assert all(d.num_rows < 5000 for d in dealt)
    parts = lm_scoring.made(spark.createDataFrame(pa.concat_tables(dealt).to_pandas(), lm_scoring.DEALT))
    got = {r["key"]: r["n"] for r in parts.filter("kind = 0").select("keys", "data").mapInArrow(lm_scoring._words, "key long, n long").collect()}
    data, offs = common.utf8(pa.array(texts))
    hashes, n = np.unique(lm_scoring._word_rows(data, offs)[0].view(np.int64), return_counts=True)
    assert got == dict(zip(hashes.tolist(), n.tolist()))


def test_lm_pairs_leave_their_tasks_by_bucket(spark):
    """What follows pairs of words goes out as a row for each bucket, and merges to what all texts agree on."""
    texts = [" ".join(f"w{i}" for i in range(300)), "w0 w1 w2 other w7 w8 w9 w10 w11", "w5 w6 end"]
    found = [[b for b in lm_scoring._pairs(iter([pa.RecordBatch.from_arrays([pa.array([t])], names=["text"])]))] for t in texts]
    dealt = [pa.Table.from_batches([lm_scoring._pairs_packed(2, f)]) for f in found]
    assert all(d.num_rows <= 4 for d in dealt)
    rows = pa.concat_tables(dealt)
    got = {}
    for bucket in range(4):
        part = rows.filter(pa.array([b == bucket for b in rows.column("bucket").to_pylist()]))
        if part.num_rows:
            got |= {k: (n, same) for k, n, same in zip(*(lm_scoring._same(part).column(c).to_pylist() for c in ("key", "n", "same")))}
    want = {}
    for t in texts:
        raw = b"\0" * 4 + t.encode() + b"\0"
        data = np.frombuffer(t.encode(), np.uint8)
        places, keys, _ = lm_scoring.word_pairs(*lm_scoring.padded(data, np.array([0, len(data)])))
        for key, at in zip(keys.view(np.int64).tolist(), places.tolist()):
            want.setdefault(key, []).append(follows(raw, at))
    want = {k: (len(v), os.path.commonprefix(v)) for k, v in want.items() if os.path.commonprefix(v)}
    assert got == want
