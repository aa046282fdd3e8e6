"""Operators 6, 7 and 8 against the libraries, brute force and exact packing."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import odd_docs, odd_rows, rows_of

from gatewise.llm import packing, secrets, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = ["", "It's 12,5 don't'Ve  x", "ÀÉî ñ ß ﬁ Ⅷ ½ ² ǅ", "日本語 かな ハングル 한국어", "á ẹ́", "<|endoftext|> x <|startoftext|>", "\x01 \x02\x7f\x85​  z", "🙂👨‍👩‍👧 ok", "ΑΣ ΑΣΑ İI", "_a_ --- ...!!! 3.14", "x" * 3000, "1234567890" * 20, "\ta \n\n b\r\n", "don’t “quote” – dash — €"]


def test_encoder_gives_the_ids_of_the_file(spark, sf_dir):
    slow = tokenizers.Tokenizer.from_file(WORDS)
    encode = packing.Encoder(WORDS)
    for text in HARD + [r["text"] or "" for r in rows_of(spark, sf_dir)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, text[:80]


def check_packing(rows, got, capacity):
    slow = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    for r in rows:
        ids = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[r[0], k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(g["length"] for g in got) // capacity)


def test_packing_over_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir)]
    n, least = check_packing(rows, packing.query(spark, sf_dir).collect(), 2048)
    assert n <= least + 1


@pytest.mark.parametrize("capacity", [2048, 8])
def test_packing_of_odd_rows(spark, capacity):
    docs = odd_docs(spark)
    check_packing(odd_rows(), packing.best_fit_packing(docs, WORDS, capacity).collect(), capacity)
    assert packing.best_fit_packing(docs.limit(0), WORDS, capacity).count() == 0


def optimal(sizes, capacity):
    """Fewest sequences by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            left = list(rooms)
            left.remove(room)
            go(i + 1, [*left, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def placed(counts, capacity):
    """Checks a plan; the number of its sequences."""
    seen, fill = Counter(), defaultdict(list)
    for length, first, n, at, offset in packing.plan(dict(counts), capacity):
        for i in range(n):
            seen[length, first + i] += 1
            fill[at + i].append((offset, length))
    assert seen == Counter((k, i) for k, n in counts.items() for i in range(n))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def test_plans_are_close_to_optimal():
    rng = np.random.default_rng(0)
    over = 0
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        counts = Counter(rng.integers(1, capacity + 1, int(rng.integers(1, 10))).tolist())
        got, best = placed(counts, capacity), optimal(list(counts.elements()), capacity)
        assert best <= got <= best + 1
        over += got - best
    assert over <= 6
    assert placed({3: 100_000, 2: 50_000, 5: 7}, 8) == -(-(300_000 + 100_000 + 35) // 8)
    assert packing.plan({}) == []


def test_dominating_sets_are_in_an_optimal_plan():
    rng = np.random.default_rng(1)
    for _ in range(120):
        capacity = int(rng.integers(6, 24))
        counts = Counter(rng.integers(1, capacity + 1, 8).tolist())
        left = packing.Lengths(dict(counts))
        length = int(rng.choice(list(counts)))
        left.take(length, 1)
        mates = packing.dominating(left, length, capacity)
        if mates is None:
            continue
        rest = counts - Counter([length, *mates])
        assert 1 + optimal(list(rest.elements()), capacity) == optimal(list(counts.elements()), capacity)


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def test_secrets_over_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in secrets.query(spark, sf_dir).collect()}
    docs = rows_of(spark, sf_dir)
    assert len(got) == len(docs)
    for d in docs:
        g, want = got[d["doc_id"]], base_spans(d["text"])
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        text = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want]
        assert g["base_sha256"] == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert [s for s in g["spans"].split(",") if s and not s.startswith("guess")] == text


def test_secrets_of_odd_texts(spark):
    texts = [None, "", "PassWord : 'abcdefgh1", "token=short", "AKIA" + "Z" * 12, "AKIA1", "f" * 31, "é" * 5 + "0" * 32, "password=" + "A" * 100_000, "api_key=\"Zx9!kQ2#mW7@\"", "paſſword=abcdefgh12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "guess"] for r in secrets.secret_spans(docs).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert secrets.secret_spans(odd_docs(spark)).count() == len(odd_rows())
    assert secrets.secret_spans(odd_docs(spark).limit(0)).count() == 0


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password") < cost("passw0rd1") < cost("xK9$vQ2mZp")
    assert cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 5 and cost("1999-12-31") < 7
    assert cost("") == 0 and cost("tR8!zLq0#Wm4") > 14
    spans = secrets.spans_of("the pwd is tR8!zLq0#Wm4 and token: password and Bearer aZ9kQ2mW7xT4", 8.0)
    assert [s for s in spans if s[1] == 3][0][0] == 11 and len([s for s in spans if s[1] == 3]) == 2


MORE = {"patience": 40, "tree": 7, "love": 3}


@functools.cache
def cheapest(value):
    """The same costs by trying all segmentations of short values."""
    ranks = {**MORE, **{w: min(i + 1, MORE.get(w, i + 1)) for i, w in reversed(list(enumerate(secrets.WORDS)))}}
    best = np.inf
    for cut in itertools.product((0, 1), repeat=len(value) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(value)]
        best = min(best, sum(part_cost(value, a, b, ranks) + np.log10(2) for a, b in zip(at, at[1:])))
    return best


def part_cost(value, a, b, ranks):
    part, low = value[a:b], value[a:b].lower()
    kinds = [sum(map(secrets._brute, part))]
    for text, more in ((low, 0), (low.translate(secrets.SWAPS), 1)):
        if text in ranks and len(part) >= 3:
            kinds.append(np.log10(ranks[text]) + np.log10(2) * (more + (part != low)))
    m = secrets.DATE.match(value, a)
    if m and m.end() == b:
        kinds.append(np.log10(200 * (365 if b - a > 4 else 1)))
    if len(set(part)) == 1 and len(part) >= 3:
        kinds.append(secrets._brute(part[0]) + np.log10(len(part)))
    walk = secrets.walk_cost(low.translate(secrets.MARKS))
    if walk is not None:
        kinds.append(walk)
    for p in range(2, len(part) // 2 + 1):
        if part[:p] * (len(part) // p) == part:
            kinds.append(cheapest(part[:p]) + np.log10(len(part) // p))
    return min(kinds)


@pytest.mark.parametrize("value", ["redasd", "Loveqq", "xzzzz9", "keyqwe1", "A1b2C3", "1999-12-31", "tr33l0ve", "abcabcabc", "1qaz2wsx", "x1990y", "!@#qwe", "zzzzzzzz", "P@tience", "31.12.99ab", "ababXabab", "treetree", "qazwsxedc", "aaaab"])
def test_guess_cost_is_the_minimum(value):
    assert secrets.guess_cost(value, more=MORE) == pytest.approx(cheapest(value), abs=1e-9)


def ranked(texts):
    """Ranks of the words of all texts, in plain Python."""
    n = Counter()
    for text in texts:
        own = {r for v in secrets._values(text) for r in re.findall(r"[^\W\d_]+", v.lower())}
        n.update(w for w in set(re.findall(r"[^\W\d_]+", text.lower())) - own if 3 <= len(w) <= 40)
    sizes = Counter(n.values())
    rank = {k: sum(m for j, m in sizes.items() if j >= k) for k in sizes}
    return {w: rank[k] for w, k in n.items()}


def test_guess_cost_of_random_values():
    """Parts of runs, walks and stretches of blocks beside each other, by all segmentations."""
    rng = random.Random(7)
    pieces = ["aa", "aaa", "qwe", "rty", "zaq", "ab", "abab", "love", "1990", "12", "!@", "X", "9", "tree", "ewq"]
    for _ in range(60):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(2, 5)))[:12]
        assert secrets.guess_cost(value, more=MORE) == pytest.approx(cheapest(value), abs=1e-9), value


def plain_repetitions(value):
    found = {}
    for p in range(1, len(value) // 2 + 1):
        i = 0
        while i + p < len(value):
            j = i
            while j + p < len(value) and value[j] == value[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b, p) for (a, b), p in found.items() if p > 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=40))
def test_repetitions(value):
    assert secrets.repetitions(value) == plain_repetitions(value)


def test_long_values():
    """Runs, walks, blocks and words of any length, in memory in proportion to the value."""
    rng = random.Random(3)
    block = "".join(rng.choice("bcdfghjkmnpqrstvwxz0123456789") for _ in range(300))
    cost = secrets.guess_cost
    assert cost(block * 3) == pytest.approx(cost(block) + np.log10(3) + np.log10(2), abs=1e-6)
    assert cost("qwertyuiop" * 1000) < 8 and cost("1qaz" + "z" * 5000) < 11
    assert secrets.values_of("key " + "q" * 300_000 + "://bob:hunter2@x") == [(300_011, 300_018)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    parts = list(secrets._parts(letters))
    assert max(map(len, parts)) <= secrets.STARTS * 40
    assert set().union(*parts) == {letters[i:j] for i in range(len(letters)) for j in range(i + 3, min(len(letters), i + 40) + 1)}


def test_common_values_are_no_secrets():
    """Names and words of a corpus, walks over the keyboard and repeated blocks are cheap."""
    more = {w: 1000 + i for i, w in enumerate(("hannah", "michelle", "computer"))}
    for value in ("hannah1987", "michelle", "computer1", "1qaz2wsx", "abcabcabc", "qwertyuiop", "zaq12wsx"):
        assert secrets.guess_cost(value, more=more) < 8.0, value
    assert secrets.guess_cost("tR8!zLq0#Wm4", more=more) > 14
    assert secrets.guess_cost("ab" * 50_000) < 9 and secrets.guess_cost("a" * 100_000) < 8


def test_guess_spans_over_documents(spark, sf_dir):
    """Ranks of the whole corpus' words in plain Python give the query's spans."""
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(spark, sf_dir)}
    more = ranked(texts.values())
    got = {r["doc_id"]: r for r in secrets.query(spark, sf_dir).collect()}
    for i, text in texts.items():
        assert got[i]["spans"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in secrets.spans_of(text, 8.0, more=more))
        costs = [(a, b, secrets.guess_cost(text[a:b], more=more)) for a, b in secrets.values_of(text)]
        assert (got[i]["n_values"], got[i]["n_guessable"]) == (len(costs), sum(c < 8.0 for *_, c in costs))
        assert [x.split(":")[:2] for x in got[i]["priced"].split(",") if x] == [[str(a), str(b)] for a, b, _ in costs]
        assert [float(x.split(":")[2]) for x in got[i]["priced"].split(",") if x] == pytest.approx([c for *_, c in costs], abs=1e-3)


def test_values_inside_and_outside_base_spans(spark):
    """Spans that the method adds, and costs of values that base spans hold; many rows share a value."""
    texts = {
        1: "password = hunter2hunter2", 2: "password: tR8!zLq0#Wm4", 3: "the pwd is tR8!zLq0#Wm4", 4: "Authorization: Bearer aZ9kQ2mW7xT4vB1n", 5: "see https://bob:Gk3!vW8-zQ1x@host/x",
        6: "token=qwertyuiop", 7: None, 8: "", 9: "the passphrase is " + "中" * 5000, 10: "the key is none of these",
    }
    rows = list(texts.items()) + [(100 + i, "the pwd is tR8!zLq0#Wm4") for i in range(300)]
    got = {r["doc_id"]: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    more = ranked(t or "" for _, t in rows)
    for i, text in rows:
        text, g = text or "", got[i]
        inside = [(a, b, any(s <= a and b <= e for s, _, e in secrets.base_spans(text))) for a, b in secrets.values_of(text)]
        assert [(v["start"], v["end"], v["inside"]) for v in g["values"]] == inside
        assert [v["guesses"] for v in g["values"]] == pytest.approx([secrets.guess_cost(text[a:b], more=more) for a, b, _ in inside])
    added = {i: [texts[i][s["start"] : s["end"]] for s in got[i]["spans"] if s["kind"] == "guess"] for i in texts}
    assert added[2] == added[3] == ["tR8!zLq0#Wm4"] and added[4] == ["aZ9kQ2mW7xT4vB1n"] and added[5] == ["Gk3!vW8-zQ1x"]
    assert all(not added[i] for i in (1, 6, 7, 8, 10)) and [s["kind"] for s in got[1]["spans"]] == ["assign"]
    assert got[1]["values"][0]["guesses"] < 8 and got[6]["values"][0]["guesses"] < 8 and got[7]["spans"] == got[7]["values"] == []


def test_counts_are_those_of_the_file(spark, sf_dir):
    slow = tokenizers.Tokenizer.from_file(BYTES)
    slow.no_padding(), slow.no_truncation()
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1000 + r["doc_id"], r["text"]) for r in rows_of(spark, sf_dir)] + [(None, None), (0, HARD[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, len((t or "").encode()), len(slow.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for ranks in (RANKS, None):
        got = token_counts.count_tokens(docs, BYTES, ranks).collect()
        assert Counter((g["doc_id"], g["n_bytes"], g["n_tokens"]) for g in got) == want
        assert all(g["over_limit"] == (g["n_tokens"] > 512) for g in got)


def test_cache_is_used_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (4, "new"), (5, "new")], "doc_id long, text string")
    assert {g["from_cache"] for g in token_counts.count_tokens(one, BYTES, RANKS, cache).collect()} == {False}
    assert spark.read.parquet(cache).count() == 2
    got = {g["doc_id"]: g["from_cache"] for g in token_counts.count_tokens(two, BYTES, RANKS, cache).collect()}
    assert got == {1: True, 4: False, 5: False} and spark.read.parquet(cache).count() == 3
    token_counts.count_tokens(one, public_tokenizers.path("piece_bpe_32k.model"), None, cache).collect()
    assert spark.read.parquet(cache).count() == 5


def test_counts_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert token_counts.count_tokens(docs, BYTES, RANKS).count() == len(odd_rows())
    assert token_counts.count_tokens(docs.limit(0), BYTES, RANKS).count() == 0


def test_ordinary_words_are_no_secrets(spark):
    """Words of other texts are cheap; random letters aren't, even where copies repeat them."""
    texts = ["the secret is patience", "token: english", "patience and english lessons", "the secret is xkqzvbwnm", "the secret is xkqzvbwnm and xkqzvbwnm", "pwd: patienceenglish"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "guess"] for r in secrets.secret_spans(docs).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["xkqzvbwnm"], 4: ["xkqzvbwnm"], 5: []}


def test_words_of_many_texts_are_encoded_once():
    """Ids dealt to texts that are encoded together, with one pass over their distinct words."""
    encode, slow = packing.Encoder(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    texts = ["", None, "  two\t\tspaces \n", "It's the dog's, isn't it? 123", "the dog, the dog", " ", "x\u0301\u4e2d the dog", "É<|endoftext|>a", "e\u00e9E\u00c9 don't...!!", "a_b __c"] * 3
    sent, pieces = [], encode.pieces
    encode.pieces = lambda text, **kw: sent.append(text) or pieces(text, **kw)
    got = encode.many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [slow.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(sent) == 1 and sent[0].count("spaces") == 1
    encode.pieces = pieces
    assert encode.many([]) == [] and encode.many(["\u4e2d"]) == [encode("\u4e2d")]
    for text in HARD:
        assert encode.many([text, "x"]) == [encode(text), encode("x")], text[:80]
    col = pa.array(texts)
    assert list(packing.encoded(encode, col)) == got and list(packing.encoded(encode, col[3:7])) == got[3:7]
