"""Secret scans: fixed patterns, plus sliding-window Shannon entropy over candidate strings.

All of it is SQL expressions within a row, without shuffles. A pattern's matches and the gaps between
them come from the same regular expression; running lengths give code point offsets. Candidates are runs
of a character class; a window of fixed width slides over each. Each step counts the character that leaves and
the one that comes within the window, and brings the sum of c * log2(c) up to date by these two counts. The
least entropy of a secret depends on the candidate's character class. Candidates on the allow-list, such as
plain words and paths, are suppressed. Folds over matches go by chunks, and no piece is looked for from the
start of its text, so that time grows with the length of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, let, read_table

#: Fixed patterns: kind, expression, group whose length counts, least length.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Characters of the sliding window, the fewest of a candidate.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: Least entropy in bits of some window, by the first class that the whole candidate belongs to.
CLASSES = (("[0-9a-fA-F]+", 3.0), ("[0-9a-z]+|[0-9A-Z]+", 3.5), ("[A-Za-z0-9+/_-]+", 3.7))
_WORD = "(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)"
_PART = f"(?:[0-9]+|{_WORD}[0-9]{{0,4}})"
#: Candidates that match one of these as a whole are no secrets: numbers; joined words and numbers; UUIDs.
ALLOWED = (r"[0-9_/+-]+", f"[-_/+]*{_PART}(?:[-_/+]+{_PART})*[-_/+]*", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

_FOUND = "array<struct<start:int,rank:int,kind:string,end:int,m:string>>"


def _possessive(pattern: str) -> str:
    """The pattern for Java, whose stack a repeated group fills unless it never goes back. These here need not go back."""
    return pattern.replace(")*", ")*+")


def _located(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters or more, with the matches."""
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"), F.split(text, pattern, -1).alias("gap")
    )
    empty = F.array().cast(_FOUND)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["m"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m"))
        kept = x["m"].isNotNull() & (F.length(x["v"]) >= least)
        return F.struct(end.alias("at"), F.when(kept, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    def chunk(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["at"].alias("at"), empty.alias("spans")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["parts"], F.array(d["spans"])).alias("parts")))

    located = F.aggregate(chunks(found), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_FOUND}>").alias("parts")), chunk, lambda a: F.flatten(a["parts"]))
    return F.when(text.rlike(pattern), located).otherwise(empty)


def peak_entropy(s: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy of any `width` characters in a row of an ASCII string of at least that length."""
    bits = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)))
    less = F.array(F.lit(0.0), *(F.lit((c * math.log2(c)) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0)) for c in range(1, width + 1)))

    def of(codes: Column) -> Column:
        # Window k begins at place k (from 1). Its counts differ from those of the window before by one each.
        count = lambda first, n, c: F.size(F.filter(F.slice(codes, first, n), lambda x: x == c))
        window = lambda k: F.slice(codes, k, width)
        first = let(window(F.lit(1)), lambda w: F.aggregate(F.array_distinct(w), F.lit(0.0), lambda a, c: a + F.get(bits, F.size(F.filter(w, lambda x: x == c)))))

        def step(a: Column, k: Column) -> Column:
            gone, come = F.get(codes, k - 2), F.get(codes, k + width - 2)
            change = F.get(less, count(k, F.lit(width), come)) - F.get(less, count(k - 1, F.lit(width), gone))
            total = F.when(gone == come, a["sum"]).otherwise(a["sum"] + change)
            return let(total, lambda t: F.struct(t.alias("sum"), F.least(a["least"], t).alias("least")))

        start = let(first, lambda x: F.struct(x.alias("sum"), x.alias("least")))
        more = F.when(F.size(codes) > width, F.sequence(F.lit(2), F.size(codes) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(more, start, step, lambda a: F.lit(math.log2(width)) - a["least"] / width)

    return let(F.transform(F.split(s, ""), F.ascii), of)


def _suspicious(s: Column) -> Column:
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | s.rlike(f"^(?:{_possessive(p)})$")
    bits = F.lit(CLASSES[-1][1])
    for p, least in reversed(CLASSES[:-1]):
        bits = F.when(s.rlike(f"^(?:{p})$"), F.lit(least)).otherwise(bits)
    # Running sums carry rounding errors: an entropy that meets the bound exactly counts.
    return ~allowed & (peak_entropy(s) >= bits - 1e-9)


def spans_of(text: Column) -> Column:
    """STRUCT of base and spans: arrays of (start, rank, kind, end) by start, then kind as listed. Null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    bare = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    base = bare(F.concat(*(_located(whole, p, g, n, kind, rank) for rank, (kind, p, g, n) in enumerate(BASE))))
    more = bare(F.filter(_located(whole, CANDIDATE, 0, WINDOW, "entropy", len(BASE)), lambda x: _suspicious(x["m"])))
    return let(base, lambda b: F.struct(F.array_sort(b).alias("base"), F.array_sort(F.concat(b, more)).alias("spans")))


def scanned(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs with the STRUCT of spans_of() under `name`, in place of a column of that name; all other columns stay.

    Offsets are code points, the end exclusive. Every row keeps its place, repeated ones and null ids, too.
    """
    return docs.drop(name).withColumn(name, spans_of(F.col("text")))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with the spans (some, ascending by start) replaced by the mark; overlapping ones become one."""
    none = F.array().cast("array<string>")

    def chunk(a: Column, part: Column) -> Column:
        end = F.greatest(a["at"], F.array_max(F.transform(part, lambda x: x["end"])))

        def inside(near: Column) -> Column:
            def step(b: Column, x: Column) -> Column:
                fresh = F.array(F.substr(near, b["at"] - a["at"] + 1, x["start"] - b["at"]), F.lit(mark))
                out = F.when(x["start"] >= b["at"], F.concat(b["out"], fresh)).otherwise(b["out"])
                return F.struct(F.greatest(b["at"], x["end"]).alias("at"), out.alias("out"))

            done = F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

        return let(F.substr(text, a["at"] + 1, end - a["at"]), inside)

    last = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text)))
    return F.aggregate(chunks(spans), F.struct(F.lit(0).alias("at"), none.alias("out")), chunk, last)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of their text replaced by the mark; overlapping spans become one. Null texts stay null.

    All rows and columns stay, in their order.
    """
    text = F.col("text")
    clean = let(spans_of(text)["spans"], lambda s: F.when(F.size(s) > 0, _without(text, s, mark)).otherwise(text))
    return docs.withColumn("text", clean)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"),
    )


QUERIES = {"op6_secrets": op6_secrets}


def _base_sql() -> str:
    """Matches of each pattern with their places, from matches and the gaps between them."""
    quoted = lambda p: p.replace("'", "''")
    one = "SELECT doc_id, '{k}' AS kind, {r} AS rank, {n} AS least, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS v, string_split_regex(text, '{p}') AS gap FROM t"
    every = [*BASE, ("entropy", CANDIDATE, 0, WINDOW)]
    return " UNION ALL ".join(one.format(k=k, r=r, n=n, p=quoted(p.replace(r"\x22", '"')), g=g) for r, (k, p, g, n) in enumerate(every))


ORACLES = {
    "op6_secrets": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_base_sql()}),
u AS (SELECT doc_id, kind, rank, least, unnest(m) AS m, unnest(v) AS v, unnest(gap[1 : len(m)]) AS gap, unnest(generate_series(1, len(m))) AS i FROM f WHERE len(m) > 0),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
s AS (SELECT doc_id, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, m FROM p WHERE length(v) >= least),
c AS (SELECT * FROM s WHERE kind = 'entropy' AND NOT ({" OR ".join(f"regexp_full_match(m, '{p}')" for p in ALLOWED)})),
w AS (SELECT doc_id, start, m, i, unnest(string_split(substr(m, i, {WINDOW}), '')) AS ch FROM (SELECT doc_id, start, m, unnest(generate_series(1, length(m) - {WINDOW} + 1)) AS i FROM c)),
h AS (SELECT doc_id, start, m, i, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h FROM (SELECT doc_id, start, m, i, ch, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
e AS (SELECT doc_id, start FROM h GROUP BY doc_id, start, m HAVING max(h) >= CASE {" ".join(f"WHEN regexp_full_match(m, '{p}') THEN {bits}" for p, bits in CLASSES)} END - 1e-9),
a AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || stop AS x FROM s WHERE kind <> 'entropy' OR (doc_id, start) IN (SELECT (doc_id, start) FROM e)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(x, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base, string_agg(x, ',' ORDER BY start, rank) AS spans FROM a GROUP BY 1)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""
}
