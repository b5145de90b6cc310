"""Phrases whose words stand together far more often than apart, counted over all texts of a language.

Texts are split into pieces, and equal pieces become one with a multiplicity. n-grams of the pieces are counted level
by level: tasks add them up for as many pieces as they hold at once, deal the sums to hash buckets, and each bucket is
summed by duckdb out of core. A level looks only at n-grams whose two shorter parts may be frequent: a bit map of fixed
size, by hash, says so. A bit that several n-grams share lets some more through, which their own count then rejects, so
counts are exact for any size of the map. Candidates ask for the counts of their parts by requests that are shuffled to
where the parts are; the answers give the scores, and tell each part of a longer phrase that is as frequent as itself.
"""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, release, stage

#: Words of a phrase at most, and the occurrences that make it frequent.
LONGEST, LEAST = 5, 100
#: Phrases reported for each language.
REPORTED = 2_000
#: Bits (as a power of two) of the map of n-grams that may be frequent: 16 MB, broadcast, whatever the corpus.
MAP_BITS = 27
#: Bytes of pieces that a task adds up at once, and what duckdb keeps in memory for a bucket before it spills.
HELD, MEMORY = 4 << 20, "256MB"
_SEPARATORS = r"[.,;:!?\n\x0B\f\r]"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = 32


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n) of each distinct piece with a word: words of A-Z in lower case joined by one space, and how often it occurs.

    A null text has no pieces; a null lang counts as `und`. Other columns are ignored, ids too: repeated rows count again.
    """
    low = F.translate(F.col("text").cast("string"), _CAPITALS, _SMALL)
    split = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, _SEPARATORS)).alias("piece"))
    clean = F.regexp_replace(F.btrim("piece", F.lit(" \t")), "[ \t]+", " ")
    return split.select("lang", clean.alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


# --- n-grams of a run of pieces --------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _slots(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The bits of the map that n-grams have, from their hashes and those of their languages."""
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(0xBF58476D1CE4E5B9) ^ salt
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - MAP_BITS)).astype(np.int64)


class Run:
    """Pieces of one batch as bytes, with the places of their words."""

    def __init__(self, lang: pa.Array, piece: pa.Array):
        joined = pa.concat_arrays([piece.cast(pa.large_string())])
        bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = joined.buffers()[2] or b""
        self.data = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        space = np.flatnonzero(self.data == _SPACE)
        self.first = np.sort(np.concatenate([bounds[:-1], space + 1]))
        self.end = np.sort(np.concatenate([bounds[1:], space]))
        self.piece = np.searchsorted(bounds, self.first, side="right") - 1
        up, self._down = _odd_powers(max(HELD + (1 << 20), 1 << len(self.data).bit_length()))  # as many for each batch, so that they are made once
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum((self.data + np.uint64(1)) * up[: len(self.data)], dtype=np.uint64)])
        self.lang = lang.dictionary_encode()
        names = self.lang.dictionary.to_pylist()
        salts = np.array([int.from_bytes(x.encode()[:64], "little") % ((1 << 64) - 59) for x in names] or [0], dtype=np.uint64)
        with np.errstate(over="ignore"):
            self._salt = (salts * np.uint64(_BASE))[self.lang.indices.to_numpy(zero_copy_only=False)]

    def slots(self, words: int) -> np.ndarray:
        """The bit of each run of so many words; the last ones are of no use where they leave their piece."""
        n = max(0, len(self.first) - words + 1)
        at, end = self.first[:n], self.end[words - 1 :]
        with np.errstate(over="ignore"):
            h = (self._sums[np.maximum(end, at)] - self._sums[at]) * self._down[at]
        return _slots(h, self._salt[self.piece[:n]])

    def starts(self, words: int, shorter: np.ndarray | None) -> np.ndarray:
        """First words of the n-grams that stay in their piece and whose two parts of a word less may be frequent."""
        n = max(0, len(self.first) - words + 1)
        inside = self.piece[:n] == self.piece[words - 1 :]
        if shorter is not None and n:
            slot = self.slots(words - 1)
            may = (shorter[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            inside &= may[:n] & may[1 : n + 1]
        return np.flatnonzero(inside)

    def grams(self, starts: np.ndarray, words: int) -> pa.Array:
        at, end = self.first[starts], self.end[starts + words - 1]
        sizes = end - at
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[take])))


def _added_up(run: Run, n: np.ndarray, words: int, shorter: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    starts = run.starts(words, shorter)
    if not len(starts):
        return
    of = run.piece[starts]
    table = pa.table({"lang": run.lang.take(pa.array(of)).cast(pa.string()), "gram": run.grams(starts, words), "n": n[of]})
    table = table.group_by(["lang", "gram"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "gram", "n"])
    yield from table.cast(_COUNTS).to_batches(max_chunksize=65_536)


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of at least `least` of the partial counts in one hash bucket, by duckdb, which spills to the task's own scratch folder."""
    import duckdb

    #: Spark's own folders for spilled rows, where the cluster names them; what is there goes with the task.
    scratch = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)
    with tempfile.TemporaryDirectory(prefix="phrases-", dir=scratch) as folder:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": "false"})
        rows = pa.RecordBatchReader.from_batches(_COUNTS, (b.cast(_COUNTS) for b in batches))  # noqa: F841  duckdb finds it by name
        sums = con.sql(f"SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM rows GROUP BY lang, gram HAVING sum(n) >= {int(least)}")
        for b in sums.to_arrow_reader(65_536):
            yield b.cast(_COUNTS)
        con.close()


def counted(found: DataFrame, words: int, shorter: np.ndarray | None, least: int, hold: int = HELD) -> DataFrame:
    """(lang, gram, n) of the n-grams of `words` words in pieces (lang, piece, n) that occur at least `least` times."""
    sent = None if shorter is None else found.sparkSession.sparkContext.broadcast(shorter)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = None if sent is None else sent.value, [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= hold:
                yield from _of(held, bits)
                held, size = [], 0
        if held:
            yield from _of(held, bits)

    def _of(held: list[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            lang, piece, n = (pa.concat_arrays(t.column(k).chunks) for k in range(3))
            yield from _added_up(Run(lang, piece), n.to_numpy(), words, bits)

    partial = found.mapInArrow(grams, "lang string, gram string, n long")
    return partial.repartition("lang", "gram").mapInArrow(lambda batches: summed(batches, least), "lang string, gram string, n long")


def bit_map(grams: DataFrame) -> np.ndarray:
    """The map of n-grams (lang, gram) of one length: bytes of MAP_BITS bits, whatever the number of rows."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                run = Run(b.column(0), b.column(1))
                words = len(run.first) // b.num_rows  # all rows have as many
                first = np.arange(b.num_rows) * words
                yield pa.RecordBatch.from_arrays([pa.array(run.slots(words)[first] + 1)], ["bit"])

    found = grams.select("lang", "gram").mapInArrow(slots, "bit long")  # Spark numbers bits and blocks from 1
    blocks = found.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for r in blocks.toLocalIterator():
        bits = np.frombuffer(r["bits"], dtype=np.uint8)
        out[(r["block"] - 1) * len(bits) : r["block"] * len(bits)] = bits
    return out


# --- candidates and their parts --------------------------------------------------------------------------------------


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, hold: int = HELD) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, n, words) of every n-gram of up to `longest` words that occurs at least `least` times, (lang, n) all word occurrences)."""
    found = stage(pieces(docs))
    total = found.groupBy("lang").agg(F.sum(F.col("n") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).alias("n"))
    total, levels, shorter = stage(total), [], None
    for words in range(1, longest + 1):
        level = stage(counted(found, words, shorter, least, hold))
        levels.append(level.withColumn("words", F.lit(words)))
        if words < longest:
            shorter = bit_map(level)
    release(found)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, total


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """scored() of all texts: see there, frequent() and pieces()."""
    return scored(*frequent(docs, longest, least))


def scored(grams: DataFrame, total: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each candidate that no longer one of the same count holds.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, score = floor(1000 * a * n / (l * r)); of equal
    cuts that with the shorter first part counts. A count never exceeds that of a part, so a phrase goes exactly if one of a
    word more, in front or behind, occurs as often.
    """

    asked = grams.where("words > 1").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "words", F.split("gram", " ").alias("w"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    asked = asked.select("*", cut)
    side = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    parts = F.explode(F.array(F.struct(F.lit("l").alias("side"), side(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), side(F.col("k") + 1, F.col("words") - F.col("k")).alias("part"))))
    asked = asked.select("lang", "phrase", "a", "words", "k", parts.alias("p")).select("lang", "phrase", "a", "words", "k", "p.side", "p.part")
    # Many candidates ask for one frequent word: the side of requests is shuffled by the join itself, so that AQE can split it.
    answers = asked.join(grams.select("lang", F.col("gram").alias("part"), F.col("n").alias("of_part"), F.col("words").alias("of_words")), ["lang", "part"])
    answers = stage(answers)
    held = answers.where("of_words > 1 AND of_words = words - 1 AND of_part = a").select("lang", F.col("part").alias("phrase")).distinct()
    cuts = answers.groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("of_part"))).alias(s) for s in "lr"))
    cuts = cuts.join(total, "lang").withColumn("score", F.expr("CAST((1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) AS DECIMAL(38,0)) DIV CAST((CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0))) AS DECIMAL(38,0))"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return lowest.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(read_table(spark, sf_dir, "documents"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= REPORTED)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


_SQL = rf"""
WITH split AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\n\x0B\f\r]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x != '') AS w, count(*) AS m FROM split GROUP BY 1, 2),
totals AS (SELECT lang, CAST(sum(m * len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
grams AS (
    SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS gram, CAST(sum(m) AS BIGINT) AS f
    FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)
    GROUP BY 1, 2, 3 HAVING sum(m) >= {LEAST}),
cuts AS (
    SELECT lang, gram, words, f, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
    FROM (SELECT *, string_split(gram, ' ') AS w, unnest(range(1, words)) AS k FROM grams WHERE words > 1)),
scored AS (
    SELECT c.lang, c.gram, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, CAST(1000 * CAST(c.f AS HUGEINT) * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.gram = c.first JOIN grams y ON y.lang = c.lang AND y.gram = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
held AS (
    SELECT DISTINCT p.lang, p.gram FROM grams p JOIN grams q ON q.lang = p.lang AND q.words > p.words AND 100 * q.f >= 100 * p.f
    AND contains(' ' || q.gram || ' ', ' ' || p.gram || ' ')
    WHERE p.words > 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
FROM lowest ANTI JOIN held USING (lang, gram)
QUALIFY rank <= {REPORTED}
"""

QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": _SQL}
