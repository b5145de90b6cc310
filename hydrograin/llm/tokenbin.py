"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A shard file holds a header (magic, id width, SHA-256 of the dictionary) and one zstandard frame per
document. The index, a Parquet table, has for each document its shard, offset and length there, the number
of ids and the number of ids before it. A short document is read by one ranged read and one small frame.
The dictionary is trained on the serialized id arrays of a bounded sample. A task writes one range of
doc_ids into as many shards as it takes; these lie in a shared folder, and count only through the committed index.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .bpe import _LETTER, _NUMBER, _SPACE, PATTERN, _byte_chars, latin_pieces, vocabulary
from .shared import filesystem, new_folder, read_table, stage

#: Documents that the dictionary is trained on, at most, and the most characters of one; the dictionary's size.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY = 2_000, 10_000, 65_536
#: Compressed bytes after which a task starts the next shard; those that a range of doc_ids aims at, and the most ranges.
SHARD, RANGE, MOST_RANGES = 16_000_000, 32_000_000, 10_000
#: Bytes of text that are cut into pieces at once.
BLOCK = 1_000_000
#: Pieces whose ids a worker remembers, at about the most.
REMEMBERED = 250_000
MAGIC = b"HGTOK1"
END_ID = 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, small letter) of each UTF-16 unit: 0 white space, 1 letter, 2 number, 3 other, 4 where latin_pieces() gives None."""
    kind, small = np.full(65_536, 4, np.uint8), np.arange(65_536, dtype="<u2")
    classes = [re.compile(f"[{x}]") for x in (_SPACE, _LETTER, _NUMBER)]
    for c in range(0x250):
        if latin_pieces(chr(c)) is not None:
            low = chr(c).lower()
            kind[c], small[c] = next((k for k, x in enumerate(classes) if x.match(low)), 3), ord(low)
    return kind, small


def _sliced(values: pa.Array, bounds) -> list[bytes]:
    """The bytes of a large_binary array from each of the given positions to the next, joined."""
    _, offsets, data = values.buffers()
    cuts = np.frombuffer(offsets, "<i8", len(values) + 1, values.offset * 8)[bounds].tolist() if offsets else [0]
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Ids of whole texts from the tokenizers library, whose model is asked once for each piece that its pre-tokenizer cuts.

    The pieces of many texts are cut and told apart as arrays, as latin_pieces() cuts them. Many new ones go to the model
    in one text, between spaces; the tokens that end a word part their ids again. Texts with other than Latin letters
    or with special tokens go to the library as they are.
    """

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        if json.loads(self.library.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("the file has another pre-tokenizer")
        #: The same model, for pieces that are normal and in its byte characters already.
        self._model = Tokenizer(self.library.model)
        self._model.pre_tokenizer = WhitespaceSplit()
        self._chars = {**dict(enumerate(_byte_chars())), ord(" "): " "}
        self._kind, self._small = _tables()
        size = self.library.get_vocab_size()
        self.width = "<u2" if size <= 65_536 else "<u4"
        self._ends = np.zeros(size, dtype=bool)
        for token, i in self.library.get_vocab().items():
            self._ends[i] = token.endswith("</w>")
        #: Ids by piece, the latter in UTF-16; when there are too many, those go that were not met since the last time.
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Serialized ids of each piece."""
        text = " ".encode("utf-16-le").join(pieces).decode("utf-16-le").encode().decode("latin-1").translate(self._chars)
        ids = np.array(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width)
        raw, width = ids.tobytes(), ids.itemsize
        cuts = [0, *((np.flatnonzero(self._ends[ids]) + 1) * width).tolist()]
        if len(cuts) != len(pieces) + 1:
            raise ValueError(f"the library cuts {len(pieces)} pieces into {len(cuts) - 1}")
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces in UTF-16, number of pieces before each text and in all, texts that are not cut)."""
        raw = [t.encode("utf-16-le") for t in texts]
        # Three units of white space at the end, so that the letters behind an apostrophe can be looked up.
        units = np.frombuffer("\n".encode("utf-16-le").join([*raw, b"", b"", b""]), "<u2")
        bounds = np.cumsum([0, *(len(x) // 2 + 1 for x in raw)])
        kind = self._kind[units]
        whole = np.array(["<|" in t for t in texts], dtype=bool)
        whole[np.searchsorted(bounds, np.flatnonzero(kind == 4), "right") - 1] = True
        for k in np.flatnonzero(whole):
            kind[bounds[k] : bounds[k + 1]] = 0
        units = self._small[units]
        starts = kind == 2
        starts[0] |= kind[0] != 0
        starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != 0)
        # An apostrophe that begins a piece takes one of these endings with it, and what is left of the letters is a piece.
        at = np.flatnonzero((units == ord("'")) & starts)
        first, second = units[at + 1], units[at + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.any([(first == ord(a)) & (second == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        at, n = np.concatenate([at[one], at[two]]), np.repeat([2, 3], [one.sum(), two.sum()])
        starts[at + 1] = False
        starts[at + n] |= kind[at + n] == 1
        kept = kind != 0
        ends = np.append(np.flatnonzero(starts[kept]), kept.sum()) * 2
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(units[kept])])
        return pieces, np.searchsorted(np.flatnonzero(starts), bounds), whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text; a null text counts as empty."""
        texts = [t or "" for t in texts]
        pieces, bounds, whole = self._cut(texts)
        pieces = pieces.dictionary_encode()
        distinct = _sliced(pieces.dictionary, slice(None))
        if len(self._known) > REMEMBERED // 2:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        values = [known.get(p) for p in distinct]
        new = []
        for k in [k for k, x in enumerate(values) if x is None]:
            if (x := older.get(p := distinct[k])) is None:
                new.append(k)
            else:
                values[k] = known[p] = x
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for k, x in zip(some, self._learn([distinct[k] for k in some])):
                values[k] = x
                if len(distinct[k]) <= 128:
                    known[distinct[k]] = x
        ends = np.cumsum([0, *map(len, values)], dtype="<i8")
        ids = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(values))])
        found = _sliced(ids.take(pieces.indices), bounds)
        others = np.flatnonzero(whole).tolist()
        for k, x in zip(others, self.library.encode_batch_fast([texts[k] for k in others], add_special_tokens=False) if others else ()):
            found[k] = np.array(x.ids, dtype=self.width).tobytes()
        return found


#: Kept by a worker from task to task.
_LOADED: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    if spec not in _LOADED:
        _LOADED[spec] = Encoder(spec)
    return _LOADED[spec]


def blocks(sizes) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with these sizes: about BLOCK in all, or one text that is longer."""
    at = np.cumsum(sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def train(docs: DataFrame, spec: str) -> bytes:
    """The dictionary for docs (doc_id, text); empty where the sample is too small to train one.

    The sample is of the first short texts, for which only the first files are read: short documents are what a
    dictionary helps, and the ids that come back do not depend on it.
    """
    short = docs.select("text").where(F.length("text").between(1, SAMPLE_CHARS))
    texts = [r["text"] for r in short.take(SAMPLE_ROWS)]
    found = [x for a, b in blocks([len(t) for t in texts]) for x in _encoder(spec).encode(texts[a:b]) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY, found).as_bytes()
    except zstandard.ZstdError:
        return b""


def _frames(docs: DataFrame, spec, dictionary) -> DataFrame:
    """(doc_id, n_tokens, frame) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        shared = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        press = zstandard.ZstdCompressor(level=3, dict_data=shared)
        end = np.array([END_ID], dtype=encoder.width).tobytes()
        for b in batches:
            for first, last in blocks(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = b.slice(first, last - first)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                n = pa.array([len(x) // len(end) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([press.compress(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "frame"])

    return docs.mapInArrow(of, "doc_id long, n_tokens long, frame binary")


def write_tokens(docs: DataFrame, path: str) -> tuple[DataFrame, bytes]:
    """(index, dictionary) of the written files: one row per row of docs, in ascending doc_id order.

    path: a tokenizers file, read by the driver and broadcast with the dictionary (both under 2 MB). Rows of
    one doc_id follow one another by length and content; a null doc_id comes first.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = spark.sparkContext.broadcast(train(docs, spec.value))
    frames = stage(_frames(docs, spec, dictionary))
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, 1 + size // RANGE))
    folder = new_folder(spark)
    width, mark = _encoder(spec.value).width, hashlib.sha256(dictionary.value).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        part, out, name, offset, start = TaskContext.get().partitionId(), None, "", 0, 0
        for b in batches:
            rows = []
            for doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok"
                    out = fs.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                    out.write(MAGIC + width.encode() + mark)
                    offset = len(MAGIC) + len(width) + len(mark)
                out.write(frame)
                rows.append((part, name, doc_id, start, n, offset, len(frame)))
                start, offset = start + n, offset + len(frame)
                if offset >= SHARD:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), *[pa.int64()] * 5))], ["part", "file", "doc_id", "start", "n_tokens", "offset", "length"])
        if out is not None:
            out.close()

    keys = [F.asc_nulls_first("doc_id"), F.length("frame").asc(), F.col("frame").asc()]
    ordered = frames.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    written = stage(ordered.mapInArrow(write, "part long, file string, doc_id long, start long, n_tokens long, offset long, length long"))
    # One row per range, MOST_RANGES at most.
    before, at = {}, 0
    for r in written.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before[r["part"]] = at
        at += r["n"]
    first = spark.createDataFrame(list(before.items()), "part long, first long")
    index = written.join(F.broadcast(first), "part").select("file", "doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "offset", "length")
    return index, dictionary.value


def read_tokens(index: DataFrame, dictionary: bytes) -> DataFrame:
    """(doc_id, start, ids BINARY as little-endian unsigned 32-bit integers) of the index's rows, read from their files."""
    shared = index.sparkSession.sparkContext.broadcast(dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hashlib.sha256(shared.value).digest()
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        name, f, width = None, None, ""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, ids = b.slice(at, 256), []
                for file, offset, length in zip(*(part.column(k).to_pylist() for k in (0, 4, 5))):
                    if file != name:
                        fs, path = filesystem(file)
                        name, f = file, fs.open_input_file(path)
                        head = f.read_at(len(MAGIC) + 3 + len(mark), 0)
                        width = head[len(MAGIC) : len(MAGIC) + 3].decode()
                        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) + 3 :] != mark:
                            raise ValueError(f"{file}: another format or dictionary")
                    ids.append(np.frombuffer(unpress.decompress(f.read_at(length, offset)), dtype=width).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return index.mapInArrow(read, "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, dictionary = write_tokens(read_table(spark, sf_dir, "documents"), vocabulary())
    found = read_tokens(index, dictionary)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
