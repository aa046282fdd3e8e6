"""The pipeline's run() against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from helpers import odd_docs
from gatewise.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_run_packs_in_the_order_of_the_mix(spark, sf_dir, monkeypatch):
    """Pieces are cut, ranked, planned and numbered in plain Python, from the mix of the rows that reach it."""
    seen = {}

    def mix(spark, docs, sf_dir):
        seen["docs"] = docs
        return corpus_pipeline.mix(spark, docs, sf_dir)

    monkeypatch.setattr(mixing.mixed, "__defaults__", (None, 20_000, *mixing.mixed.__defaults__[2:]))
    monkeypatch.setattr(packing, "ROWS", 40)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, mix if n == "mix" else f) for n, f in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in seen["docs"].collect()}
    mixed = mixing.mix_sources(seen["docs"], block=20_000).collect()
    assert len(mixed) == len(text) > 50
    windows = defaultdict(lambda: defaultdict(list))
    for place, r in enumerate(sorted(mixed, key=lambda r: (r["slot"], r["source"], r["start"]))):
        tokens = len(encode(text[r["doc_id"]] or "")) // 4 + 1
        for piece, start in enumerate(range(0, tokens, 2048)):
            length = min(2048, tokens - start)
            windows[place // 40][length].append((r["doc_id"], piece, start, length))
    assert len(windows) > 1
    want, ahead = Counter(), 0
    for _, by_length in sorted(windows.items()):
        rows = packing.plan({k: len(v) for k, v in by_length.items()})
        for length, first, n, at, offset in rows:
            for i in range(n):
                want[(*by_length[length][first + i], ahead + at + i, offset)] += 1
        ahead += max(at + n for _, _, n, at, _ in rows)
    found = Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["sequence_id"], g["offset"]) for g in got)
    assert found == want
    # Without the mix the result is another one.
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, (lambda spark, docs, sf_dir: docs) if n == "mix" else f) for n, f in corpus_pipeline.STAGES])
    other = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["sequence_id"], g["offset"]) for g in other) != found


def odd_folder(spark, folder, empty=False):
    """Odd rows and labels as the tables that the stages read."""
    docs, labels = odd_docs(spark), spark.createDataFrame([(3, 1, 0), (6, 1, 0), (7, None, None), (None, 0, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        (df.limit(0) if empty else df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, long texts and clashing names: every stage but the last gives rows of the table, whole."""
    folder = odd_folder(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name == "pack":
            break
        assert out.columns == docs.columns
        before, after = (Counter(map(repr, df.collect())) for df in (docs, out))
        assert not after - before
        if name == "mix":
            assert after == before
        if name == "exact":
            assert sorted({r["text"] or "" for r in docs.collect()}) == sorted(r["text"] or "" for r in out.collect())
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
    pieces = out.collect()
    assert {(p["doc_id"], p["piece"]) for p in pieces} >= {(r["doc_id"], 0) for r in docs.collect()}
    assert sorted(p["sequence_id"] for p in pieces if p["offset"] == 0) == list(range(1 + max(p["sequence_id"] for p in pieces)))


def test_stages_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path, empty=True)).count() == 0
