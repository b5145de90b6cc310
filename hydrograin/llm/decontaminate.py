"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A text is normalised to its lower-cased words joined by single spaces and scanned once. A window is
`width` consecutive words of an item; an item of fewer words, but not none, is one window. Hits are
mapped back to code point spans of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, stage

#: Bytes of benchmark text in one broadcast automaton (about 100 times that in memory at most). Beyond it
#: the items go to several automata, each scanned in turn, and the results are merged per row.
AUTOMATON_BYTES = 4_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (digits, letters and all non-ASCII characters) as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def windows(text: str | None, width: int) -> list[bytes]:
    w = words_of(text)
    return [b" " + b" ".join(w[i : i + width]) + b" " for i in range(max(1, len(w) - width + 1))] if w else []


def _automaton(items: list[tuple[str, str | None]], width: int):
    owners: dict[bytes, list[str]] = {}
    for item, text in items:
        for w in set(windows(text, width)):
            owners.setdefault(w, []).append(item)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(ids)))
    if owners:
        found.make_automaton()
    return found if owners else None


def word_spans(text: str, at: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the runs of consecutive words whose numbers are in `at` (ascending)."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8)
    inside = np.concatenate([[False], folded != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(at) > 1)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(at) - 1]])
    return [(int(point[edges[at[a], 0]]), int(point[edges[at[b], 1]])) for a, b in zip(first, last)]


def scan(text: str | None, automaton) -> tuple[int, list[int], list[str], list[tuple[int, int]]]:
    """(words, numbers of the words hit, items, spans of the hits in the original) of one text."""
    w = words_of(text)
    if not w or automaton is None:
        return len(w), [], [], []
    flat = b" " + b" ".join(w) + b" "
    hits = list(automaton.iter(flat.decode("latin-1")))
    if not hits:
        return len(w), [], [], []
    gaps = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
    hit, items = np.zeros(len(w) + 1, dtype=np.int64), set()
    ends = np.searchsorted(gaps, [e for e, _ in hits])
    for e, (_, (n, ids)) in zip(ends, hits):
        hit[e - n] += 1
        hit[e] -= 1
        items.update(ids)
    at = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
    return len(w), at.tolist(), sorted(items), word_spans(text, at)


def occurs(text: str | None, automaton) -> bool:
    """Whether any window occurs in the text."""
    if automaton is None or not (w := words_of(text)):
        return False
    return next(automaton.iter((b" " + b" ".join(w) + b" ").decode("latin-1")), None) is not None


def _parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in parts of bounded size, so that neither driver nor executors hold more than one."""
    part, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL").toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield part
            part, size = [], 0
    yield part


def _scanned(rows: DataFrame, part: list[tuple[str, str | None]], width: int) -> DataFrame:
    """The columns of SCHEMA for each of rows (row, doc_id, text) by the items of one part, and its row."""
    shared = rows.sparkSession.sparkContext.broadcast(_automaton(part, width))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                found = [scan(t, automaton) for t in part.column(2).to_pylist()]
                n, hit, items, spans = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([len(h) for h in hit], pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["row", "doc_id", "n_words", "n_hit", "hit_words", "items", "spans"],
                )

    return rows.mapInArrow(of, "row long, " + SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, numbers of the hit words, items (as strings, sorted) and spans.

    Null and empty texts have no words; items with a null id are ignored; items that repeat an id count
    once. With several automata (see AUTOMATON_BYTES) the documents are written with a row number, by which
    the results are merged: rows that repeat a doc_id, or have none, stay apart.
    """
    rows, parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _parts(benchmark, limit)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scanned(rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), first, width).drop("row")
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = _scanned(rows, first, width).unionByName(_scanned(rows, second, width))
    for part in parts:
        found = found.unionByName(_scanned(rows, part, width))
    return _merge(found)


def merged_spans(parts: list[tuple[list[int], list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """The spans of the runs of all words hit, from (numbers of the words hit, spans of their runs) of each part.

    The first word of a run is the first one of a run in some part, and so is the last.
    """
    start, end, words = {}, {}, set()
    for hit, spans in parts:
        have = set(hit)
        words |= have
        for w, (s, _) in zip([w for w in hit if w - 1 not in have], spans):
            start[w] = s
        for w, (_, e) in zip([w for w in hit if w + 1 not in have], spans):
            end[w] = e
    return list(zip([start[w] for w in sorted(words) if w - 1 not in words], [end[w] for w in sorted(words) if w + 1 not in words]))


def _merge(found: DataFrame) -> DataFrame:
    both = found.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.filter(F.collect_list(F.struct("hit_words", "spans")), lambda x: F.size(x["spans"]) > 0).alias("parts"),
    )
    of = F.udf(lambda parts: merged_spans([(p["hit_words"], p["spans"]) for p in parts]), "array<struct<start:int,end:int>>")
    return both.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "hit_words", "items", of("parts").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of an item."""
    spark = docs.sparkSession
    # All columns of docs lie in one struct: their names may be anything.
    kept = docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("doc"))
    schema = kept.schema
    for part in _parts(benchmark, limit):
        shared = spark.sparkContext.broadcast(_automaton(part, width))

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for b in batches:
                yield b.filter(pa.array([not occurs(t, automaton) for t in b.column(0).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(of, schema)
    return kept.select("doc.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {
    "op8_decontaminate": r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_aggregate(w[k : k + least(len(w), 10) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, list_aggregate(w[k : k + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id""",
}
