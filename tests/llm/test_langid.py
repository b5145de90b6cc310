"""The byte network: its recursion and gradients against plain versions, its bounds, and accuracy on held-out rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrograin.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, held_out string, `a.b` string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1.0, "x", "y") for i, t, lang in rows], SCHEMA)


def plain_states(net, data, d):
    """States of one direction after each byte, one unit and one number at a time."""
    k, h, out = net.hidden, [0.0] * net.hidden, []
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for byte in data:
        w, u = net.W[d][:, byte], net.U[d]
        sums = [sum(float(u[i, j]) * h[j] for j in range(k)) for i in range(3 * k)]
        z = [sigmoid(float(w[i]) + sums[i]) for i in range(k)]
        r = [sigmoid(float(w[k + i]) + sums[k + i]) for i in range(k)]
        n = [math.tanh(float(w[2 * k + i]) + r[i] * (sums[2 * k + i] + float(net.b[d, i, 0]))) for i in range(k)]
        h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(k)]
        out.append(h)
    return out


def plain_positions(net, data):
    fwd, bwd = plain_states(net, data, 0), plain_states(net, data[::-1], 1)[::-1]
    out = []
    for f, b in zip(fwd, bwd):
        logits = [float(net.c[i, 0]) + sum(float(net.V[0, i, j]) * f[j] + float(net.V[1, i, j]) * b[j] for j in range(net.hidden)) for i in range(len(net.languages))]
        e = [math.exp(v) for v in logits]
        out.append([v / sum(e) for v in e])
    return out


@pytest.fixture
def net():
    net = langid.Network(["aa", "bb", "cc"], hidden=3, seed=5)
    net.b += np.float32(0.3)
    return net


def test_positions_and_pooling_against_one_number_at_a_time(net):
    texts = ["Abc é 1", "", None, "x", "日本 ab." * 9, "z" * 700 + " ÄÖ " * 150, "12 !"]
    for t in texts[:1] + texts[3:5]:
        assert np.allclose(langid.positions(net, t), plain_positions(net, t.lower().encode()), atol=1e-5)
    pooled = langid.probabilities(net, texts)
    for t, p in zip(texts, pooled):
        data, sums, n = (t or "").lower().encode(), np.zeros(3), 0
        for at in range(0, len(data), langid.CORE):
            low = max(0, at - langid.MARGIN)
            for k, q in enumerate(plain_positions(net, data[low : at + langid.CORE + langid.MARGIN]), low):
                if at <= k < at + langid.CORE and (data[k] >= 128 or chr(data[k]).isalpha()):
                    sums, n = sums + q, n + 1
        assert np.allclose(p, sums / max(n, 1), atol=1e-4)


def test_gradients(net):
    net = langid.Network(["aa", "bb"], hidden=3, seed=2, dtype=np.float64)
    data = np.frombuffer(b"one two three quatre cinq", dtype=np.uint8)
    low, high, label = np.array([0, 4, 14]), np.array([4, 14, 25]), np.array([0, 1, 1])
    x = langid.both_ways(data, low, high)
    _, grad = net.gradients(x, high - low, label)
    for name in net.NAMES:
        value, g = getattr(net, name), grad[name]
        for i in np.argsort(-abs(g).ravel())[:6]:
            at, was = np.unravel_index(i, g.shape), 0
            was = value[at]
            value[at] = was + 1e-5
            up, _ = net.gradients(x, high - low, label)
            value[at] = was - 1e-5
            down, _ = net.gradients(x, high - low, label)
            value[at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    net = langid.trained(langid.sample(docs))
    rows = langid.predicted(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 150 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.98 * len(out)
    first = docs.where("lang = 'de'").first()["text"]
    edges = made(spark, [(1, None, "de"), (2, "", None), (3, "12 + 3 = 15 …", "fr"), (None, first, "x"), (4, first, None), (4, first, None), (5, (first + " ") * 400, "de"), (6, "퟿🙂🙂", None)])
    got = sorted((r["doc_id"] or 0, r["held_out"], r["lang_pred"], r["score"] > 0.5) for r in langid.predicted(edges, net).collect())
    assert got == [(0, True, "de", True), (1, held(1), "und", False), (2, held(2), "und", False), (3, held(3), "und", False), (4, held(4), "de", True), (4, held(4), "de", True), (5, held(5), "de", True), (6, held(6), "und", False)]
    assert langid.predicted(edges.where("false"), net).count() == 0


def test_nothing_to_learn_from(spark):
    docs = made(spark, [(1, "some words", None), (2, None, "en")])
    assert langid.sample(docs) == []
    got = langid.predicted(docs, langid.trained([])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    one = langid.trained([("en", "some words")] * 3, epochs=1)
    assert [r["lang_pred"] for r in langid.predicted(docs, one).collect()] == ["en", "und"]


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows = [(i, f"text number {i} " * 20, ["en", "de"][i % 7 == 0]) for i in range(600)] + [(3, "same", "en")] * 500 + [(5, "held out", "en")] * 20
    got = langid.sample(made(spark, rows), 40)
    assert len(got) == 40 and sum(lang == "de" for lang, _ in got) == 20 and all(len(t) <= langid.STRETCH for _, t in got)
    kept_back = {str(i) for i in range(600) if held(i)}
    only = made(spark, [(i, f"n{i}n", "en") for i in range(600)])
    assert not kept_back & {t.strip("n") for _, t in langid.sample(only, 10_000)}
    with pytest.raises(ValueError, match="languages"):
        langid.sample(only.withColumn("lang", F.col("doc_id").cast("string")), 20)
