"""Quality rules as a short-circuit cascade of SQL expressions.

Each rule is a boolean over figures of the text (words, lines, 3-word windows, ...). The cascade asks the rules
one after another and stops at the first that rejects: figures that only later rules need are then never
computed. The order comes from a sample: cost is the time that a rule's own expression takes there, selectivity
the share it rejects, and rules run by falling rejections per second. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, let, read_table, stage

#: Rows of the sample that orders the rules, and the most characters of one; timed runs of each rule.
SAMPLE_ROWS, SAMPLE_CHARS, RUNS = 200, 20_000, 1

_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÍÓ"
_WINDOW = 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _grams(words: Column) -> Column:
    """A hash of each window of three words."""
    return F.when(
        F.size(words) >= _WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - _WINDOW), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_at(grams: Column) -> Column:
    """Ascending places of the windows found twice or more. Sorted by hash, equal ones stand next to each other."""
    ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twice(r: Column) -> Column:
        same = lambda k, s: F.coalesce(F.get(r, k)["g"] == s["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(r, lambda s, k: same(k - 1, s) | same(k + 1, s)), lambda s: s["i"]))

    return let(ranked, twice)


def _covered(words: Column) -> Column:
    """Words inside a window that is found twice or more, the first one included."""

    def of(grams: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last"))

        def step(a: Column, at: Column) -> Column:
            return F.struct((a["n"] + F.least(at - a["last"], F.lit(_WINDOW))).alias("n"), at.alias("last"))

        several = F.aggregate(_repeated_at(grams), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(several)

    return let(_grams(words), of)


#: name: figure of a text and its words.
FIGURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.length(F.translate(text, SPACE, "")),
    "n_symbols": lambda text, words: _without(text, _SYMBOLS),
    "n_lines": lambda text, words: F.size(_lines(text)),
    "n_dup_lines": lambda text, words: let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda text, words: _covered(words),
    "n_capitals": lambda text, words: _without(text, _CAPITALS),
}

#: name: whether the figures reject. The first two are fixed by contract; integer arithmetic keeps all of them exact.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "too_short": lambda x: x("n_words") < 50,
    "repeated_windows": lambda x: 100 * x("n_repeat_words") > 50 * x("n_words"),
    "symbols": lambda x: 10 * x("n_symbols") > x("n_words") * 3,
    "duplicate_lines": lambda x: let(x("n_dup_lines"), lambda n: F.when(n > 2, 100 * n > 30 * x("n_lines")).otherwise(F.lit(False))),
    "word_length": lambda x: let(x("word_chars"), lambda n: (n < 2 * x("n_words")) | (n > 15 * x("n_words"))),
    "capitals": lambda x: 100 * x("n_capitals") > 50 * x("word_chars"),
}


def verdict(text: Column, order: Sequence[str] = tuple(RULES), figures: Sequence[str] = ()) -> Column:
    """STRUCT of the named figures (BIGINT) and rejected_by: the first rule in `order` that rejects, null if none does.

    A rule's figures are computed when its turn comes, and not at all once an earlier rule has rejected. Figures
    that are asked for are computed for every text, once, and the rules take them from there. A null text has no
    words, lines or characters. Works within a row, without Python.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def judge(words: Column) -> Column:
        asked = F.struct(F.lit(0).alias("_"), *(FIGURES[f](whole, words).cast("long").alias(f) for f in figures))

        def cascade(known: Column) -> Column:
            of = lambda f: known[f] if f in figures else FIGURES[f](whole, words)
            rejected = F.lit(None).cast("string")
            for rule in reversed(order):
                rejected = F.when(RULES[rule](of), F.lit(rule)).otherwise(rejected)
            return F.struct(*(known[f].alias(f) for f in figures), rejected.alias("rejected_by"))

        return let(asked, cascade)

    return let(_words(whole), judge)


def order_of(docs: DataFrame) -> list[str]:
    """Rule names by falling rejections per second on the first SAMPLE_ROWS texts of at most SAMPLE_CHARS characters.

    Only the first files are read for these; another sample would change the time taken, but no verdict. The cost
    of a rule is the shortest of RUNS runs of its expression after a first one, less that of none. An empty table
    keeps the written order.
    """
    text = F.col("text").cast("string")
    texts = [r[0] for r in docs.select(text).where(F.length(text) <= SAMPLE_CHARS).take(SAMPLE_ROWS)]
    if not texts:
        return list(RULES)
    sample = stage(docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("text")))

    def run(order: list[str]) -> tuple[int, float]:
        # Without an exchange, whose output a second run would take over.
        judged, times, n = sample.select(verdict(F.col("text"), order)["rejected_by"]), [], 0
        judged.collect()
        for _ in range(RUNS):
            began = time.perf_counter()
            n = sum(r[0] is not None for r in judged.collect())
            times.append(time.perf_counter() - began)
        return n, min(times)

    idle, worth = run([])[1], {}
    for rule in RULES:
        n, took = run([rule])
        worth[rule] = n / max(1e-3, took - idle)
    return sorted(worth, key=lambda rule: -worth[rule])


def judged(docs: DataFrame, order: Sequence[str] | None = None, figures: Sequence[str] = (), name: str = "quality") -> DataFrame:
    """docs with the STRUCT of verdict() under `name`, in place of a column of that name; all other columns stay.

    Every row keeps its place, repeated ones and those without a doc_id, too.
    """
    return docs.drop(name).withColumn(name, verdict(F.col("text"), order or order_of(docs), figures))


def accepted(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects. Null and empty texts are too short."""
    return docs.where(verdict(F.col("text"), order or order_of(docs))["rejected_by"].isNull())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    q = judged(read_table(spark, sf_dir, "documents").select("doc_id", "text"), None, asked).select("doc_id", "quality")
    base = (F.col("quality.n_words") < 50) | (100 * F.col("quality.n_repeat_words") > 50 * F.col("quality.n_words"))
    return q.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in asked], base.alias("base_failed"), F.col("quality.rejected_by").isNull().alias("kept"))


QUERIES = {"op7_quality": op7_quality}

_MEASURES_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÍÓ', '')) AS n_upper
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > 3 * n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_upper > 50 * word_chars AS more_failed FROM m)"""

ORACLES = {
    "op7_quality": f"WITH {_MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept FROM v",
}
