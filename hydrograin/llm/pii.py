"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detection, surrogates and rewriting are DataFrame operations. An entity is (kind, normal form); its surrogate
depends only on a key, the kind and the normal form, so that it is the same wherever the entity occurs
(coreference), in whatever format it is written. A surrogate keeps the kind's format: digits stay digits,
letters stay letters of the same case and script, punctuation stays, check digits of card numbers keep their
validity, names keep title, gender and number of parts. Surrogates that meet one another, or an entity that
occurs, are drawn again until all are distinct. E-mail addresses and names gain letters with each draw, so that
there are always enough of them; numbers have no more surrogates than their digits allow.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, read_table, stage

#: Titles by gender; a name is a title and one to three capitalised words. Fixed values.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof", "Mx")
_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))

#: Kinds in order of precedence, with their patterns.
KINDS = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"),
    ("id", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}\p{{Ll}}+(?:[\x20-]\p{{Lu}}\p{{Ll}}+){{0,2}}"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)

#: Given-name endings that the gender decides, by script; stems are drawn letter by letter.
_ENDINGS = {"latin": {"m": "on", "f": "ia", "n": "is"}, "cyrillic": {"m": "ов", "f": "ова", "n": "их"}}
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
#: Other scripts keep themselves: block in Java's patterns, and the letters drawn from (first, number of them).
_SCRIPTS = (("Greek", 0x3B1, 17), ("Hebrew", 0x5D0, 27), ("Arabic", 0x628, 19), ("Devanagari", 0x915, 37), ("Hiragana", 0x3042, 64), ("Katakana", 0x30A2, 64), ("Hangul", 0xAC00, 1024), ("Han", 0x4E00, 1024))
#: Letters (of a domain) or syllables (of a name) that further draws add at most: 19 ** 12 domain labels.
GROWTH = 12
#: Kinds of digits alone, and the rounds of their permutation.
NUMBERS, ROUNDS = ("ip", "phone", "card", "id"), 8


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string, in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(c ^ pad for c in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _found(text: Column) -> Column:
    """Array of (i, m, gap): the matches in order, with the text in front of each; a last one without match has the rest."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("m"), F.split(text, ANY, -1).alias("gap"))
    return F.transform(both, lambda x, i: F.struct(i.alias("i"), x["m"].alias("m"), x["gap"].alias("gap")))


def _kind(raw: Column) -> Column:
    found = F.lit("name")
    for kind, p in reversed(KINDS[:-1]):
        found = F.when(raw.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(found)
    return found


def _normal(kind: Column, raw: Column) -> Column:
    """What makes two mentions the same entity: digits of numbers, lower case of the rest; names keep their gender."""
    bare = F.regexp_replace(raw, rf"^(?:{_TITLE})\.?\x20", "")
    title = F.regexp_extract(raw, rf"^({_TITLE})", 1)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")
    return (
        F.when(kind.isin("phone", "card", "id"), F.regexp_replace(raw, "[^0-9]", ""))
        .when(kind == "name", F.concat(gender, F.lit(":"), F.lower(bare)))
        .when(kind == "ip", F.array_join(F.transform(F.split(raw, r"\."), lambda x: x.cast("int").cast("string")), "."))
        .otherwise(F.lower(raw))
    )


def _draw(seed: Column, at: Column, among: Column) -> Column:
    """One character of `among`, by the hash of the seed and the place."""
    return F.substr(among, F.pmod(F.xxhash64(seed, at), F.length(among).cast("long")).cast("int") + 1, F.lit(1))


def _characters(s: Column, seed: Column) -> Column:
    """Each letter of s, which is in lower case, and each digit drawn anew; all else, and other scripts' marks, kept."""

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _draw(seed, i, F.lit("0123456789")))
            .when(c.rlike(r"\p{IsCyrillic}"), _draw(seed, i, F.lit(_CONSONANTS["cyrillic"] + _VOWELS["cyrillic"])))
            .when(c.rlike(r"\p{IsLatin}"), _draw(seed, i, F.lit(_CONSONANTS["latin"] + _VOWELS["latin"])))
            .when(c.rlike(r"\p{L}"), other(c, i))
            .otherwise(c)
        )

    def other(c: Column, i: Column) -> Column:
        drawn = _draw(seed, i, F.lit(_CONSONANTS["latin"] + _VOWELS["latin"]))
        for script, first, n in _SCRIPTS:
            drawn = F.when(c.rlike(rf"\p{{Is{script}}}"), _draw(seed, i, F.lit("".join(map(chr, range(first, first + n)))))).otherwise(drawn)
        return drawn

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    parts = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def _name(normal: Column, seed: Column, more: int) -> Column:
    gender, words = F.substr(normal, F.lit(1), F.lit(1)), F.split(F.substr(normal, F.lit(3), F.length(normal)), r"(?<=[\x20-])")

    def word(w: Column, i: Column, script: str) -> Column:
        c, v = F.lit(_CONSONANTS[script]), F.lit(_VOWELS[script])
        stem = F.concat(F.initcap(_draw(seed, i * 8, c)), _draw(seed, i * 8 + 1, v), _draw(seed, i * 8 + 2, c), _draw(seed, i * 8 + 3, v), _draw(seed, i * 8 + 4, c))
        for k in range(more):
            stem = F.concat(stem, _draw(seed, i * 8 - 1000 * (k + 1), v), _draw(seed, i * 8 - 1000 * (k + 1) + 1, c))
        end = F.when(gender == "m", _ENDINGS[script]["m"]).when(gender == "f", _ENDINGS[script]["f"]).otherwise(_ENDINGS[script]["n"])
        return F.concat(stem, end, F.regexp_extract(w, r"([\x20-])$", 1))

    each = lambda w, i: F.when(w.rlike(r"\p{IsCyrillic}"), word(w, i, "cyrillic")).otherwise(word(w, i, "latin"))
    return F.array_join(F.transform(words, each), "")


def _word_surrogate(kind: Column, normal: Column, key: str, attempt: int) -> Column:
    """Surrogate of an e-mail address or a name; later attempts are longer."""
    more, letters = min(attempt, GROWTH), F.lit(_CONSONANTS["latin"] + _VOWELS["latin"])

    def mail(seed: Column) -> Column:
        label = let(F.concat(seed, F.lit("@")), lambda s: F.concat(_characters(F.regexp_extract(normal, r"@(.*)\.[^.]*$", 1), s), *[_draw(s, F.lit(-1 - k), letters) for k in range(more)]))
        return F.concat(_characters(F.substring_index(normal, "@", 1), seed), F.lit("@"), label, F.lit(".example."), F.substring_index(normal, ".", -1))

    drawn = lambda seed: F.when(kind == "email", mail(seed)).otherwise(_name(normal, seed, more))
    return let(_hmac(key, F.concat_ws("|", kind, normal, F.lit(str(attempt)))), drawn)


def _moved(kind: Column, a: Column, b: Column, most_a: Column, most_b: Column, key: str) -> Column:
    """The pair (a, b), a number in two parts below the given bounds, moved by a keyed permutation that keeps none in place.

    P is a Feistel network with HMAC rounds. The pair goes back through P, b steps on by 1 to 9 places, and forth
    through P: a permutation like P, in which nothing stays where it is.
    """
    size = F.concat_ws("|", kind, most_a.cast("string"), most_b.cast("string"))
    value = lambda r, x: F.conv(F.substr(_hmac(key, F.concat_ws("|", size, r.cast("string"), x.cast("string"))), F.lit(1), F.lit(15)), 16, 10).cast("long")

    def through(pair: Column, sign: int) -> Column:
        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            left = F.when(even, F.pmod(s["a"] + sign * F.pmod(value(r, s["b"]), most_a), most_a)).otherwise(s["a"])
            right = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * F.pmod(value(r, s["a"]), most_b), most_b))
            return F.struct(left.alias("a"), right.alias("b"))

        rounds = range(ROUNDS) if sign > 0 else range(ROUNDS - 1, -1, -1)
        return F.aggregate(F.array(*map(F.lit, rounds)), pair, step)

    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = 1 + F.pmod(value(F.lit(-1), F.lit(0)), F.lit(9))
    return let(through(pair, -1), lambda p: through(F.struct(p["a"].alias("a"), F.pmod(p["b"] + step, most_b).alias("b")), 1))


def _number_surrogate(kind: Column, normal: Column, key: str) -> Column:
    """Surrogate of a number: all octets of an address; all digits of others but the check digit of a card and the first of a phone."""

    def digits(s: Column) -> Column:
        n = F.length(s)
        half = F.floor(n / 2).cast("int")
        power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        part = lambda at, k: F.concat(F.lit("0"), F.substr(s, at, k)).cast("long")
        moved = _moved(kind, part(F.lit(1), half), part(half + 1, n - half), power(half), power(n - half), key)
        return let(moved, lambda p: F.concat(F.when(half > 0, F.lpad(p["a"].cast("string"), half, "0")).otherwise(""), F.lpad(p["b"].cast("string"), n - half, "0")))

    octet = lambda i: F.get(F.split(normal, r"\."), F.lit(i)).cast("long")
    wide = F.lit(65_536).cast("long")
    ip = let(
        _moved(kind, octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), wide, wide, key),
        lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string")),
    )

    def card(front: Column) -> Column:
        last = F.pmod(_luhn(normal) - _luhn(F.concat(front, F.lit("0"))), F.lit(10))
        return F.concat(front, last.cast("string"))

    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", let(digits(F.substr(normal, F.lit(1), F.length(normal) - 1)), card))
        .when(kind == "phone", F.concat(F.substr(normal, F.lit(1), F.lit(1)), digits(F.substr(normal, F.lit(2), F.length(normal)))))
        .otherwise(digits(normal))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) with distinct surrogates within a kind.

    entities: (kind, normal), distinct. Numbers are permuted. Of addresses or names that draw the same surrogate
    the smallest keeps it; the others, and those that drew an existing entity, draw a longer one until none is left.
    """
    entities = stage(entities.select("kind", "normal"))
    kind, normal = F.col("kind"), F.col("normal")
    settled = stage(entities.where(kind.isin(*NUMBERS)).select("kind", "normal", _number_surrogate(kind, normal, key).alias("surrogate")))
    left, attempt = entities.where(~kind.isin(*NUMBERS)), 0
    taken = left.select("kind", F.regexp_replace("normal", "^[mfn]:", "").alias("low")).distinct()
    while not left.isEmpty():
        drawn = left.withColumn("surrogate", _word_surrogate(kind, normal, key, attempt))
        drawn = drawn.withColumn("low", F.lower("surrogate")).join(taken, ["kind", "low"], "left_anti")
        if attempt:
            drawn = drawn.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        found = stage(drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal")).select("kind", "normal", "surrogate"))
        settled = settled.unionByName(found)
        left = stage(left.join(found, ["kind", "normal"], "left_anti"))
        attempt += 1
    return settled


def _written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention: separators of numbers, capitals, title."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct((a["n"] + digit.cast("int")).alias("n"), F.concat(a["out"], F.when(digit, F.substr(surrogate, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    number = F.aggregate(F.split(raw, ""), start, step, lambda a: a["out"])
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.?\x20", 0)
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (
        F.when(kind.isin("phone", "card", "id"), number)
        .when(kind == "name", F.concat(title, surrogate))
        .when(upper, F.upper(surrogate))
        .when(raw.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2), F.length(surrogate))))
        .otherwise(surrogate)
    )


def pseudonymised(docs: DataFrame, key: str, name: str = "pii") -> DataFrame:
    """docs with a STRUCT under `name`, in place of a column of that name: the text with surrogates, and its spans.

    The key decides on all surrogates: whoever knows it can tell whether a guess is right. spans: (kind, raw length,
    replacement) in order. Null texts stay null, texts without entities stay as they are, repeated rows stay. Only
    documents with entities are written out and joined; all others pass by. Addresses, numbers and cards are found by
    their form, names behind a title, in Latin and Cyrillic letters.
    """
    text = F.col("text").cast("string")
    spans = "array<struct<kind:string,n:int,new:string>>"
    docs = docs.drop(name)
    some = F.coalesce(text.rlike(ANY), F.lit(False))
    plain = docs.where(~some).withColumn(name, F.struct(text.alias("text"), F.array().cast(spans).alias("spans")))
    # All columns of docs lie in one struct: none can clash with those beside it.
    hit = stage(docs.where(some).select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"), _found(text).alias("found")))
    mention = hit.select("row", F.explode("found").alias("x")).where("x.m IS NOT NULL").select("row", "x.i", F.col("x.m").alias("raw")).withColumn("kind", _kind(F.col("raw")))
    mention = mention.withColumn("normal", _normal(F.col("kind"), F.col("raw")))
    known = surrogates(mention.select("kind", "normal").distinct(), key)
    new = mention.join(known, ["kind", "normal"]).select(
        "row", F.struct("i", "kind", F.length("raw").alias("n"), _written(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new")).alias("x")
    )
    by_row = new.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("new"))
    pieces = F.transform("found", lambda x: F.array(x["gap"], F.coalesce(F.get(F.col("new"), x["i"])["new"], F.lit(""))))
    replaced = F.struct(
        F.array_join(F.flatten(pieces), "").alias("text"),
        F.transform("new", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"), x["new"].alias("new"))).cast(spans).alias("spans"),
    )
    changed = hit.join(by_row, "row").select("doc.*", replaced.alias(name))
    return plain.unionByName(changed)


#: Key of the registered query alone: a user's own is a secret.
QUERY_KEY = "key of the registered query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text with surrogates, and how many entities of each kind were replaced."""
    found = pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "pii")
    n = lambda kind: F.size(F.filter("pii.spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k, _ in KINDS], F.col("pii.text").alias("text"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
