"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word's symbols there is exactly one last token of its encoding: the token t that
is a suffix of the prefix, and that is compatible with the last token of what stands before it. The
suffixes come from an automaton over the vocabulary, compatibility from the merge ranks: a pair is
compatible if encoding the two strings together gives back the pair. Following the stored tokens
backwards from the end of the word gives the exact ids of greedy merging.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import read_table

#: Chunks of text, and pieces of these, that a worker remembers before it starts anew; pairs of tokens: four times as many.
REMEMBERED = 400_000

#: A text is in normal form, and lower-cases letter by letter, if neither it nor its lower case has one of these. Some
#: capitals below U+0250 have a small letter beyond it.
_BEYOND = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The pre-tokenizer's pattern that _PIECE stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What Unicode calls white space; unlike str.split() without U+001C to U+001F.
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_BLANK = re.compile("[\x1c-\x1f]")
_END = "</w>"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


def latin_pieces(text: str) -> list[str] | None:
    """The pre-tokenizer's pieces of a text without special tokens that stays below U+0250 in lower case, too; None for other texts."""
    low = text.lower()
    return None if "<|" in text or _BEYOND.search(text) or (not text.isascii() and _BEYOND.search(low)) else _PIECE.findall(low)


class Bpe:
    """Encoder and decoder for a tokenizers file of the word-end, byte-level kind."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        if data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the file has another pre-tokenizer")
        vocab: dict[str, int] = data["model"]["vocab"]
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        self._bytes = {c: chr(b) for b, c in enumerate(_byte_chars())}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(data["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (k, t)
            self.rank.setdefault(t, k)
            self.halves.setdefault(t, (a, b))
        self._suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self._whole(i):
                self._suffixes.add_word(s := self._symbols(token), (len(s), i))
        self._suffixes.make_automaton()
        self._fits: dict[int, bool] = {}
        self._known: dict[str, tuple[list[int], str]] = {}
        self._words: dict[str, tuple[list[int], str]] = {}
        # Unicode tables differ from version to version: beyond ASCII the library's own decide on normal forms and pieces.
        self._library = Tokenizer.from_str(spec)

    def _symbols(self, token: str) -> str:
        """One character per symbol: the byte, plus 256 where the word ends."""
        ends = token.endswith(_END) and len(token) > len(_END)
        s = "".join(self._bytes[c] for c in (token[: -len(_END)] if ends else token))
        return s[:-1] + chr(ord(s[-1]) + 256) if ends else s

    def _stays(self, a: int, b: int, limit_a: float, limit_b: float) -> bool:
        """Whether no merge ever crosses the border between a and b, going back in time from the given limits."""
        while True:
            over = self.merged.get((a, b))
            if over and over[0] < limit_a and over[0] <= limit_b:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit_a, a = ra, self.halves[a][1]
            else:
                limit_b, b = rb, self.halves[b][0]

    def _whole(self, t: int) -> bool:
        """Whether encoding the token's own string gives the token."""
        if t not in self.halves:
            return True
        a, b = self.halves[t]
        return self._whole(a) and self._whole(b) and self._stays(a, b, self.rank[t], self.rank[t] - 1)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= 4 * REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._stays(a, b, float("inf"), float("inf"))
        return known

    def encode_word(self, s: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer, given as symbols."""
        last = [-1] * (len(s) + 1)
        size = [0] * (len(s) + 1)
        for end, (n, t) in self._suffixes.iter(s):
            end += 1
            if last[end] < 0 and (end == n or (last[end - n] >= 0 and self.compatible(last[end - n], t))):
                last[end], size[end] = t, n
        ids, end = [], len(s)
        while end:
            if last[end] < 0:
                raise ValueError(f"the vocabulary has no token for the end of {s[:end]!r}")
            ids.append(last[end])
            end -= size[end]
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of text without white space."""
        ids: list[int] = []
        for part in self._special.split(chunk) if self._special and "<" in chunk else [chunk]:
            if part in self.specials:
                ids.append(self.specials[part])
            elif part:
                for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part)):
                    ids += self.encode_word("".join([self._bytes[c] for c in piece[:-1]]) + chr(ord(self._bytes[piece[-1]]) + 256))
        return ids

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens, joined by spaces."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def _keep(self, known: dict, key: str, ids: list[int]) -> tuple[list[int], str]:
        if len(known) >= REMEMBERED:
            known.clear()
        found = ids, self.decode(ids)
        if len(key) < 64:
            known[key] = found
        return found

    def _of_chunk(self, chunk: str) -> tuple[list[int], str]:
        return self._keep(self._known, chunk, self.encode_chunk(chunk))

    def _of_piece(self, piece: str) -> tuple[list[int], str]:
        raw = piece.encode()
        return self._keep(self._words, piece, self.encode_word(raw[:-1].decode("latin-1") + chr(raw[-1] + 256)))

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """(ids, decoded text) of a whole text."""
        text = text or ""
        if (pieces := latin_pieces(text)) is not None:
            known, of = self._words.get, self._of_piece
        else:
            pieces = [c for c in _BLANK.split(text) if c] if _ODD_BLANK.search(text) else text.split()
            known, of = self._known.get, self._of_chunk
        parts = [known(c) or of(c) for c in pieces]
        return [i for ids, _ in parts for i in ids], " ".join([d for ids, d in parts if ids])


#: Kept by a worker from task to task.
_LOADED: dict[str, Bpe] = {}


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids ARRAY<INT>, decoded STRING) of each row; a null text counts as empty, which has no ids.

    path: a tokenizers file, read by the driver and broadcast (under 2 MB). Other columns are ignored.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = spec.value
        if text not in _LOADED:
            _LOADED[text] = Bpe(text)
        bpe = _LOADED[text]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, ids array<int>, decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(found: DataFrame, *more: str) -> DataFrame:
    return found.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(read_table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
