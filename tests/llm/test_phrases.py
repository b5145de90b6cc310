"""Phrase mining against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hydrograin.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, gram string, `a.b` string"


def brute(docs, longest, least):
    """{(lang, phrase): (a, l, r, n, score)} of documents (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    held = {(lang, w[i : i + k]) for (lang, w), a in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 100 * f[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in held:
            score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score)
    return out


def made(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (lang, t) in enumerate(docs)], SCHEMA)


def found(df):
    rows = df.collect()
    out = {(r["lang"], r["phrase"]): tuple(r[c] for c in ("a", "l", "r", "n", "score")) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("hold", [phrases.HELD, 300])
def test_against_brute_force(spark, hold):
    rng = random.Random(1)
    words = ["the", "The", "of", "é", "über-x", "日本", "a", "b c", "new york city", "in the middle of nowhere at all", "🙂"]
    docs = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t ", ".", ", ", "\n", "\r\n"]) for _ in range(rng.randrange(40)))
        docs.append((rng.choice(["en", "fr", None]), text))
    docs += [("en", None), (None, ""), ("fr", " \t. ,"), ("fr", "x"), ("en", "one two three four five six seven " * 300)] + [("en", "copy of one text. Copy of one text")] * 40
    got = found(phrases.scored(*phrases.frequent(made(spark, docs), least=7, hold=hold)))
    expected = brute(docs, 5, 7)
    assert len(expected) > 50 and got == expected


def test_repeated_words_overlap(spark):
    docs = [("en", "a a a a a a"), ("de", "a a a"), ("en", "b")]
    assert found(phrases.collocations(made(spark, docs), least=2)) == brute(docs, 5, 2)


def test_a_full_map_changes_nothing(spark, monkeypatch):
    docs = [("en", f"w{i % 7} v{i % 11} u{i % 3} end") for i in range(500)]
    one = found(phrases.collocations(made(spark, docs), least=10))
    monkeypatch.setattr(phrases, "bit_map", lambda grams: np.full(1 << (phrases.MAP_BITS - 3), 255, dtype=np.uint8))
    assert found(phrases.collocations(made(spark, docs), least=10)) == one == brute(docs, 5, 10)


def test_large_counts_are_exact(spark):
    schema = "lang string, gram string, n long, words int"
    grams = spark.createDataFrame([("en", "a", 10**15, 1), ("en", "b", 10**15 + 1, 1), ("en", "a b", 10**14 + 7, 2)], schema)
    total = spark.createDataFrame([("en", 10**16 + 3)], "lang string, n long")
    got = found(phrases.scored(grams, total))
    assert got == {("en", "a b"): (10**14 + 7, 10**15, 10**15 + 1, 10**16 + 3, 1000 * (10**14 + 7) * (10**16 + 3) // (10**15 * (10**15 + 1)))}


def test_empty(spark):
    assert found(phrases.collocations(made(spark, [("en", None)]).where("false"))) == {}
    assert found(phrases.collocations(made(spark, [("en", None), (None, " ")]), least=1)) == {}


def test_buckets_larger_than_memory():
    rows = 300_000
    batches = (pa.record_batch([pa.array(["en"] * rows), pa.array([f"word {i} and more words {i * 7}" for i in range(k, k + rows)]), pa.array([1] * rows)], schema=phrases._COUNTS) for k in range(0, 2_100_000, 150_000))
    sums = sum(b.num_rows for b in phrases.summed(batches, 2))
    assert sums == 13 * 150_000  # every row but those of the first and the last half meets another
