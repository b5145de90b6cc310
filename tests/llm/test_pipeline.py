"""The pipeline's stages on a small corpus, each against what it must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydrograin.llm import bpe, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    text = lambda n=200: " ".join(f"wort{i}" for i in rng.integers(0, 10**6, n))
    item = text(20)
    base = [text() for _ in range(6)]
    near = base[1].split()
    near[50] = "anders"
    rows = [*base, base[0], " ".join(near), base[2] + " " + item, "kurz", "### *** " * 90, base[3] + ' token = "abcdef0123456789abcdef01"', None, text() + ' password="S3cr3tS3cr3t"']
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "de", "s", len(t or "")) for i, t in enumerate(rows)], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(f(spark, docs, folder))
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert ids["quality_rules"] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 13]
    # Row 8 holds row 2 and a benchmark item: 196 of 220 shingles in common.
    assert ids["near_dedup"] == [0, 1, 2, 3, 4, 5, 13]
    assert ids["decontamination"] == [0, 1, 2, 3, 4, 5, 13] == ids["secret_scan"] == ids["bpe"]
    redacted = {r.doc_id: r for r in seen["secret_scan"].collect()}[13]
    assert redacted.text.endswith(" [SECRET]\"") and redacted.n_chars == len(redacted.text)
    own = bpe.Bpe(open(bpe.vocabulary(), encoding="utf-8").read())
    assert {r.doc_id: r.ids for r in seen["bpe"].collect()} == {r.doc_id: own.encode(r.text)[0] for r in seen["secret_scan"].collect()}


def grams(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(texts):
    sets = [grams(t) for t in texts]
    return [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]


def brute_groups(texts, links):
    of = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            of[i] = of[j] = min(of[i], of[j])
    return of


def near_copies(groups, size, n_words, seed):
    """Texts and near copies of them around a similarity of 0.8: each changes up to n_words / 40 words, five shingles each."""
    rng, texts = np.random.default_rng(seed), []
    for k in range(groups):
        words = [f"wort{i}" for i in rng.integers(0, 10**6, n_words)]
        texts.append(" ".join(words))
        for _ in range(size):
            near = list(words)
            for at in rng.choice(n_words, int(rng.integers(1, n_words // 40 + 1)), replace=False):
                near[at] = f"neu{k}x{rng.integers(0, 10**6)}"
            texts.append(" ".join(near))
    return texts


def test_near_dedup_finds_nine_tenths_of_the_links_and_no_other(spark):
    texts = near_copies(120, 3, 160, 8)
    links = brute_links(texts)
    df = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    rows, sketches = simhash.sketched(df, 5)
    of = {r.set: r.id for r in sketches.collect()}
    found = {tuple(sorted((of[r.a], of[r.b]))) for r in simhash.similar_links(rows, sketches, 5, 0.8).collect()}
    assert found <= set(links)
    reached, want = brute_groups(texts, found), brute_groups(texts, links)
    share = sum(reached[i] == reached[j] for i, j in links) / len(links)
    print(f"links {len(links)}, found or reached {share:.3f}")
    assert share >= 0.9 and len(links) > 200
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert set(kept) >= {i for i in range(len(texts)) if want[i] == i} and kept == [i for i in range(len(texts)) if reached[i] == i]


def test_near_dedup_of_copies_nulls_and_repeated_ids(spark):
    a, b, c = (t for t in near_copies(3, 0, 100, 3))
    rows = [(7, a), (3, a), (3, b), (3, b), (None, c), (None, c), (9, None), (8, ""), (None, "x y"), (4, "x  Y")]
    df = spark.createDataFrame([(i, t, "de", "s", 1) for i, t in rows], SCHEMA).withColumns({n: F.lit("z") for n in ("row", "doc", "set", "fp", "c", "first")})
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (3, b), (None, c), (8, ""), (4, "x  Y")], key=str)


def test_near_dedup_of_a_large_group_of_near_copies(spark):
    """All copies of one text, most of them just above or below the bound: nine tenths of what can go goes."""
    texts = near_copies(1, 250, 300, 5)
    df = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    want = brute_groups(texts, brute_links(texts))
    least = sum(want[i] == i for i in range(len(texts)))
    left = len(corpus_pipeline.near_dedup(spark, df, "").collect())
    assert least <= left and len(texts) - left >= 0.9 * (len(texts) - least)


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() == 7
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
