"""Toxicity scores: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding undoes the common disguises: letters of other scripts that look Latin, digits and signs in place
of letters, and punctuation between words. The lexicon is learnt: of all word beginnings in a bounded
sample of labelled rows, those much more common in toxic rows, each with its log-odds as weight. A match
inside an exception phrase does not count. Three figures of the matches (sum of weights by the word, number,
largest weight) go through a logistic curve that is fitted on the same sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, stage

#: Labelled rows that the lexicon is learnt from, at most: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Beginnings of words in the lexicon, at most; each has 4 to 9 characters.
LEXICON = 2_000
SHORTEST, LONGEST = 4, 9
#: Least number of toxic rows, and least log-odds, of an entry.
LEAST_ROWS, LEAST_ODDS = 8, 2.0
#: Phrases in which an entry is harmless, in folded form.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "idiot proof", "sore loser")

#: Look-alike letters of other scripts, then digits and signs used for letters.
LOOKALIKES = dict(zip("авсеһіјкмнорѕтухԁɡαβεικνορτυχ", "abcehijkmhopstyxdgabeiknoptux"))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))
_SPACES = dict.fromkeys("\t\n\x0b\x0c\r!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~", " ")
_TABLE = str.maketrans({**LOOKALIKES, **SUBSTITUTES, **_SPACES})


def fold(text: str | None) -> str:
    """Lower case, look-alikes and substitutes as Latin letters, ASCII punctuation as spaces, with a space in front."""
    return " " + (text or "").lower().translate(_TABLE)


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows to learn from; held-out rows never are."""
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(rows)
    # `rows` ids of 12 bytes: the bound of what is broadcast.
    return stage(docs.select("doc_id", "text").join(F.broadcast(stage(known)), "doc_id"))


def lexicon(learn: DataFrame) -> dict[str, float]:
    """Weights of the word beginnings that mark toxic rows; none where a class is missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts = {w[:k] for w in set(fold(text).split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
                seen[toxic].update(starts)
        keys = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([seen[0][k] for k in part], pa.int64()), pa.array([seen[1][k] for k in part], pa.int64())], ["entry", "clean", "bad"]
            )

    n = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counted = learn.select("text", F.col("toxic").cast("int")).mapInArrow(count, "entry string, clean long, bad long")
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    best = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST_ROWS)
    best = best.withColumn("w", odds).where(F.col("w") >= LEAST_ODDS)
    kept: dict[str, float] = {}
    for r in best.orderBy(F.desc(F.col("w") * F.sqrt("bad")), F.desc(F.length("entry")), "entry").limit(LEXICON).collect():
        if not any(r["entry"].startswith(k) or k.startswith(r["entry"]) for k in kept):
            kept[r["entry"]] = r["w"]
    return kept


def matcher(weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """Automaton over entries at word starts (weight) and exception phrases (None); null if there are none."""
    found = ahocorasick.Automaton()
    for k, w in weights.items():
        found.add_word(f" {k}", (len(k) + 1, w))
    for k in exceptions:
        found.add_word(f" {k}", (len(k) + 1, None))
    if weights:
        found.make_automaton()
    return found if weights else None


def evidence(text: str | None, automaton) -> tuple[float, float, float]:
    """(sum of weights by the square root of the number of words, log of the matches, largest weight)."""
    flat = fold(text)
    hits = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(flat)] if automaton else []
    if not hits:
        return 0.0, 0.0, 0.0
    harmless = [(s, e) for s, e, w in hits if w is None]
    found = [w for s, e, w in hits if w is not None and not any(a <= s and e <= b for a, b in harmless)]
    if not found:
        return 0.0, 0.0, 0.0
    return sum(found) / math.sqrt(len(flat.split())), math.log1p(len(found)), max(found)


def with_evidence(docs: DataFrame, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """docs (doc_id, text and one more column) with the three figures in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(matcher(weights, exceptions))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = np.array([evidence(t, shared.value) for t in part.column(1).to_pylist()]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x[:, k]) for k in range(3))], ["doc_id", "more", "x0", "x1", "x2"])

    return docs.mapInArrow(of, "doc_id long, more int, x0 double, x1 double, x2 double")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps: intercept, then a coefficient for each column."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b.tolist()


def scored(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, held_out, score): whole texts, scores from 0 to 1. Null and empty texts score as texts without matches.

    Without labels of both classes every score is 0.
    """
    learn = sample(docs, labels, rows)
    weights = lexicon(learn)
    if not weights:
        score = F.lit(0.0)
        found = docs.select(F.col("doc_id").cast("long"))
    else:
        seen = with_evidence(learn.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("toxic").cast("int").alias("more")), weights)
        seen = np.array(seen.select("x0", "x1", "x2", "more").collect(), dtype=float)  # LABELLED_ROWS x 4 figures at most
        b = fit(seen[:, :3], seen[:, 3])
        found = with_evidence(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("int").alias("more")), weights)
        score = 1 / (1 + F.exp(-(b[0] + b[1] * F.col("x0") + b[2] * F.col("x1") + b[3] * F.col("x2"))))
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), score.alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
