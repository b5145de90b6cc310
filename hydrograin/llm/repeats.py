"""Repeated byte strings across documents, by common-prefix intervals of enhanced suffix arrays.

One suffix array of a whole corpus would not fit anywhere, so suffixes are dealt out by content:

1. Texts are written as blocks of about BLOCK bytes into a shared folder; later steps name a block and read it.
2. Of every `length`-byte window the ANCHOR-byte string with the smallest hash is its anchor. Equal windows
   have equal anchors, so only windows whose anchor occurs in two documents can repeat. Each block sends every
   hash once, and gets back those that are shared.
3. Around each shared anchor the context is cut out that holds all windows it stands for. Contexts go to the
   bucket of their anchor, once per block and content. A bucket builds the suffix array of its contexts, the
   common prefixes of neighbours, and scans these with a stack: the intervals at `length` or more whose
   left neighbours differ are its maximal repeats, with all their occurrences.
4. Blocks get back, for each window, the smallest doc_id that it occurs in, and mark what is removed.

A string that every document holds is sent once per block in each step, whatever its number of copies.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, read_table, stage

#: Bytes of a string that counts as repeated, and of its anchors.
LENGTH, ANCHOR = 50, 24
#: Bytes of text in a block, and bytes of text per bucket that anchors and contexts are dealt to.
BLOCK, BUCKET, LEAST_BUCKETS = 4_000_000, 4_000_000, 64

_LAST = np.iinfo(np.int64).max
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def write_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Write the texts as blocks; the committed table (block, n) names them. A null text counts as empty."""
    folder = new_folder(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        held: list[tuple[int | None, bytes]] = []
        names, sizes, now = [], [], 0

        def close() -> None:
            name = uuid.uuid4().hex
            ids = np.array([_LAST if d is None else d for d, _ in held], dtype="<i8")
            missing = np.array([d is None for d, _ in held], dtype=np.uint8)
            lengths = np.array([len(t) for _, t in held], dtype="<i8")
            head = np.array([len(held)], dtype="<i8").tobytes() + ids.tobytes() + missing.tobytes() + lengths.tobytes()
            with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(zstandard.ZstdCompressor(level=1).compress(head + b"".join(t for _, t in held)))
            names.append(f"{folder}/{name}")
            sizes.append(now)
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.append((d, (t or "").encode()))
                    now += len(held[-1][1])
                    if now >= size:
                        close()
                        now = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["block", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(write, "block string, n long"))


def read_block(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(doc_ids, whether the id is missing, starts with the end appended, all texts) of a block."""
    fs, path = filesystem(name)
    with fs.open_input_stream(path, compression=None) as f:
        raw = zstandard.ZstdDecompressor().decompress(f.read())
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids = np.frombuffer(raw, "<i8", n, 8)
    missing = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    lengths = np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    return ids, missing, np.concatenate([[0], np.cumsum(lengths)]), raw[8 + 17 * n :]


def _words_at(buffer: bytes, n: int, order: str = "<u8") -> np.ndarray:
    """The 8 bytes at each of the first n places, as integers, without a copy. The buffer goes on 8 bytes behind them."""
    return np.ndarray((n,), dtype=order, buffer=buffer, strides=(1,))


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` values in a row."""
    span = 1
    while 2 * span <= width:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(buffer: bytes, starts: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of all anchors of the texts that begin at `starts`, in order of place.

    A window is named by the place it begins at; windows never cross texts.
    """
    found = []
    step, width = 1 << 20, length - size + 1
    n = int(starts[-1])
    padded = buffer + bytes(length + 8)
    ends = starts[1:]
    for at in range(0, n, step):
        # Anchors between at and at + step: windows from `low`, hashes up to `high`.
        low, high = max(0, at - width + 1), min(n, at + step + width - 1)
        part = padded[low : high + length]
        m = high - low
        with np.errstate(over="ignore"):
            h = _words_at(part, m) * _C[0]
            h ^= h >> np.uint64(29)
            for k in range(8, size, 8):
                h += _words_at(part[k:], m) * _C[k // 8]
                h ^= h >> np.uint64(31)
                h *= _C[3]
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        near = ends[np.searchsorted(ends, low, "right") :]
        near = near[: np.searchsorted(near, high + length, "right") + 1]
        blocked = np.zeros(m + length + 1, dtype=np.int32)
        for back, mark in ((size - 1, 1), (length - 1, 1 << 16)):
            a, b = np.clip(near - back - low, 0, m + length), np.clip(near - low, 0, m + length)
            np.add.at(blocked, a, mark)
            np.add.at(blocked, b, -mark)
        blocked = np.cumsum(blocked)[:m]
        h[(blocked & 0xFFFF) > 0] = _TOP
        w = m - width + 1
        if w <= 0:
            continue
        least = _slide(h, width, np.minimum)
        least[blocked[:w] >= 1 << 16] = 0
        top = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        at_place = np.flatnonzero(top == h)
        at_place = at_place[(at_place + low >= at) & (at_place + low < at + step)]
        if not len(at_place):
            continue
        edge = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        own = edge[at_place[:, None] + np.arange(width)] == h[at_place][:, None]
        first = at_place + own.argmax(axis=1) - width + 1
        last = at_place + width - 1 - own[:, ::-1].argmax(axis=1) - width + 1
        found.append((at_place + low, h[at_place], first + low, last + low))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _pack(h: np.ndarray) -> bytes:
    """48-bit integers, six bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _split(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, members of order) of each run of equal sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part, k in zip(np.split(order, cuts), np.split(keys, cuts)):
        if len(k):
            yield int(k[0]), part


def shared_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, hashes): those of the block's anchors that occur in two texts or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                _, _, starts, text = read_block(name)
                place, h, _, _ = anchors(text, starts)
                h = _short(h)
                doc = np.searchsorted(starts, place, "right")
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                group = np.cumsum(fresh) - 1
                several = np.zeros(int(fresh.sum()), dtype=bool)
                several[group[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])]] = True
                h = h[fresh]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows = [(k, name, _pack(h[i]), np.packbits(several[i]).tobytes()) for k, i in _split(order, bucket[order])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "block", "h", "several"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        hs = [_unpack(x) for x in rows["h"]]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["several"], hs)]
        every = np.concatenate(hs)
        ranked = np.sort(every)
        again = np.unique(np.concatenate([ranked[1:][ranked[1:] == ranked[:-1]], every[np.concatenate(flags)]]))
        hits = [h[again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h] if len(again) else h[:0] for h in hs]
        return pd.DataFrame({"block": rows["block"], "h": [_pack(h) for h in hits]})[[len(h) > 0 for h in hits]]

    # A task per block: names are small, and AQE would put all of them into one partition but for the number.
    sent = blocks.select("block").repartition(max(1, blocks.count())).mapInArrow(send, "bucket long, block string, h binary, several binary")
    return sent.groupBy("bucket").applyInPandas(meet, "block string, h binary")


def contexts(name: str, hashes: list[bytes]) -> dict:
    """The distinct contexts of a block's shared anchors, and where they occur.

    place, first, count: of each occurrence; which: its context; hash, bytes (one string), at, size, doc: of each
    context, the latter its smallest doc_id in the block.
    """
    ids, missing, starts, text = read_block(name)
    place, h, first, last = anchors(text, starts)
    shared = np.sort(np.concatenate([_unpack(x) for x in hashes])) if hashes else np.zeros(0, "<u8")
    h = _short(h)
    keep = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool)
    place, h, first, last = place[keep], h[keep], first[keep], last[keep]
    size = last - first + LENGTH
    doc = ids[np.searchsorted(starts, first, "right") - 1]
    # Contexts are equal if anchor, extent and bytes are: compared as ten 8-byte words, zero behind the end.
    padded = text + bytes(96)
    words = []
    for k in range(0, 80, 8):
        w = _words_at(padded, len(text) + 8)[np.minimum(first + k, len(text) + 7)].copy()
        left = np.clip(size - k, 0, 8).astype(np.uint64)
        words.append(np.where(left == 8, w, w & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))))
    with np.errstate(over="ignore"):
        key = size.astype(np.uint64) + h * _C[1]
        for w in words:
            key = (key ^ w) * _C[0]
            key ^= key >> np.uint64(29)
    order = np.lexsort((doc, key))
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        same = (key[order][1:] == key[order][:-1]) & (size[order][1:] == size[order][:-1])
        for w in words:
            same &= w[order][1:] == w[order][:-1]
        fresh[1:] = ~same
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    top = order[fresh]
    return {"ids": ids, "missing": missing, "starts": starts, "text": text, "first": first, "size": size, "which": which, "hash": h[top], "at": first[top], "long": size[top], "doc": doc[top]}


def _gather(text: bytes, at: np.ndarray, size: np.ndarray) -> bytes:
    """The byte strings at the given places, one after another."""
    total = int(size.sum())
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    index = np.arange(total) - np.repeat(begin - at, size)
    return np.frombuffer(text, np.uint8)[index].tobytes()


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, length) of the common-prefix intervals of at least `least`, by a stack scan.

    lcp[i] is the common prefix of suffixes i - 1 and i of a suffix array, lcp[0] being 0.
    """
    long = np.concatenate([lcp >= least, [False]])
    begin = np.flatnonzero(long[:-1] & ~np.concatenate([[False], long[:-2]])) if len(lcp) else np.zeros(0, int)
    end = np.flatnonzero(long[:-1] & ~long[1:]) if len(lcp) else np.zeros(0, int)
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    low = np.minimum.reduceat(lcp, np.stack([begin, end + 1], 1).ravel()[: None if end[-1] + 1 < len(lcp) else -1])[::2]
    high = np.maximum.reduceat(lcp, np.stack([begin, end + 1], 1).ravel()[: None if end[-1] + 1 < len(lcp) else -1])[::2]
    flat = low == high
    out = [(begin[flat] - 1, end[flat], low[flat])]
    rows: list[tuple[int, int, int]] = []
    for a, b in zip(begin[~flat].tolist(), end[~flat].tolist()):
        stack: list[tuple[int, int]] = []
        for i, x in enumerate([*lcp[a : b + 1].tolist(), 0], a):
            left = i - 1
            while stack and stack[-1][0] > x:
                depth, left = stack.pop()
                rows.append((left, i - 1, depth))
            if x and (not stack or stack[-1][0] < x):
                stack.append((x, left))
    if rows:
        out.append(tuple(np.array(c, dtype=np.int64) for c in zip(*rows)))
    return tuple(np.concatenate(x) for x in zip(*out))


def maximal_repeats(text: bytes, at: np.ndarray, size: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Maximal repeats of at least `least` bytes in the strings of `text` that begin at `at` and are `size` long.

    Returns the suffix array (places in text of all suffixes of `least` bytes or more), the intervals
    (left, right, length) in it that are maximal repeats, and for each suffix the number of its string.
    Strings hold 80 bytes at most. An interval is maximal to the right as it stands, and to the left if its
    suffixes follow different bytes, or one begins its string.
    """
    windows = size - least + 1
    owner = np.repeat(np.arange(len(at)), windows)
    begin = np.cumsum(windows) - windows
    inner = np.arange(len(owner)) - begin[owner]
    place = at[owner] + inner
    left = (size[owner] - inner).astype(np.int64)
    padded = text + bytes(96)
    view = _words_at(padded, len(text) + 88, ">u8")
    words = []
    for k in range(0, 80, 8):
        w = view[np.minimum(place + k, len(text) + 87)].astype(np.uint64)
        bits = np.clip(8 * (left - k), 0, 64).astype(np.uint64)
        words.append(np.where(bits == 64, w, np.where(bits == 0, np.uint64(0), w & ~(_TOP >> np.where(bits == 64, np.uint64(0), bits)))))
    order = np.lexsort(words[::-1]) if len(place) else np.zeros(0, np.int64)
    place, left, owner, inner = place[order], left[order], owner[order], inner[order]
    lcp = np.zeros(len(place), dtype=np.int64)
    if len(place) > 1:
        open_ = np.ones(len(place) - 1, dtype=bool)
        for w in words:
            w = w[order]
            x = w[1:] ^ w[:-1]
            same = np.where(x == 0, 8, 0)
            differ = np.flatnonzero(open_ & (x != 0))
            if len(differ):
                y = x[differ]
                zero = np.zeros(len(y), dtype=np.int64)
                for b in range(7, -1, -1):
                    clear = (y >> np.uint64(8 * b)) == 0
                    zero = np.where(clear, 8 - b, zero)
                same[differ] = zero
            lcp[1:] += np.where(open_, same, 0)
            open_ &= x == 0
        lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    l, r, n = intervals(lcp, least)
    before = np.where(inner == 0, -1, np.frombuffer(padded, np.uint8)[np.maximum(place - 1, 0)].astype(np.int64))
    if len(l):
        change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
        begins = np.concatenate([[0], np.cumsum(before < 0)])
        diverse = (change[r] > change[l]) | (begins[r + 1] > begins[l])
        l, r, n = l[diverse], r[diverse], n[diverse]
    return place, (l, r, n), owner


def _range_min(x: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Minimum of x from each l to r, both included, from minima over powers of two."""
    out = np.empty(len(l), dtype=x.dtype)
    span = np.floor(np.log2(np.maximum(r - l + 1, 1))).astype(int)
    level, k = x, 0
    while len(out) and k <= span.max():
        at = np.flatnonzero(span == k)
        out[at] = np.minimum(level[l[at]], level[r[at] - (1 << k) + 1])
        level, k = np.minimum(level[: len(level) - (1 << k)], level[1 << k :]), k + 1
    return out


def first_documents(text: bytes, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each context, the smallest doc_id of all contexts that hold the same window."""
    at = np.cumsum(size) - size
    windows = size - LENGTH + 1
    begin = np.cumsum(windows) - windows
    place, (l, r, n), owner = maximal_repeats(text, at, size)
    out = np.repeat(doc, windows)
    if len(l):
        lowest = _range_min(doc[owner], l, r)
        count = r - l + 1
        each = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(l, count)
        low, extra = np.repeat(lowest, count), np.repeat(n - LENGTH, count)
        where = begin[owner[each]] + place[each] - at[owner[each]]
        for k in range(int(extra.max()) + 1):
            go = extra >= k
            np.minimum.at(out, where[go] + k, low[go])
    return out


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def repeated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, the removed byte spans and the kept bytes.

    A byte is removed if a string of LENGTH bytes that covers it also begins in a row with a smaller doc_id;
    strings are judged on the input. Rows with equal doc_ids don't count against each other. A null text counts
    as empty; a null doc_id as larger than all others.
    """
    blocks = write_blocks(docs)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET)
    shared = stage(shared_anchors(blocks, buckets))

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        c = contexts(name := rows["block"].iloc[0], list(rows["h"]))
        bucket = (c["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out = [
            (k, name, _zip(i.astype("<i4").tobytes() + c["long"][i].astype(np.uint8).tobytes() + c["doc"][i].astype("<i8").tobytes() + _gather(c["text"], c["at"][i], c["long"][i])), len(i))
            for k, i in _split(order, bucket[order])
        ]
        return pd.DataFrame(out, columns=["bucket", "block", "c", "n"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        which, size, doc, text = [], [], [], []
        for blob, n in zip(rows["c"], rows["n"]):
            raw = _unzip(blob)
            which.append(np.frombuffer(raw, "<i4", n))
            size.append(np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64))
            doc.append(np.frombuffer(raw, "<i8", n, 5 * n))
            text.append(raw[13 * n :])
        sizes, docs_ = np.concatenate(size), np.concatenate(doc)
        # Equal contexts of several blocks go into the suffix array once.
        strings = np.frombuffer(b"".join(text), np.uint8)
        wide = np.zeros((len(sizes), 80), dtype=np.uint8)
        at = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        wide[row, np.arange(len(strings)) - at[row]] = strings
        keyed = np.hstack([wide, sizes[:, None].astype(np.uint8)])
        _, top, back = np.unique(keyed.view(f"V{keyed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        lowest = np.full(len(top), _LAST)
        np.minimum.at(lowest, back, docs_)
        first = first_documents(_gather(strings.tobytes(), at[top], sizes[top]), sizes[top], lowest)
        begin = np.cumsum(sizes[top] - LENGTH + 1) - (sizes[top] - LENGTH + 1)
        out, row = [], 0
        for name, w, s in zip(rows["block"], which, size):
            b, n = begin[back[row : row + len(w)]], s - LENGTH + 1
            each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b, n)
            out.append((name, _zip(w.tobytes() + first[each].astype("<i8").tobytes()), len(w)))
            row += len(w)
        return pd.DataFrame(out, columns=["block", "c", "n"])

    sent = shared.groupBy("block").applyInPandas(send, "bucket long, block string, c binary, n long")
    known = sent.groupBy("bucket").applyInPandas(meet, "block string, c binary, n long")
    told = known.select("block", F.lit(None).cast("binary").alias("h"), "c", "n").unionByName(shared.select("block", "h", F.lit(None).cast("binary").alias("c"), F.lit(0).cast("long").alias("n")))
    told = told.unionByName(blocks.select("block", F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("c"), F.lit(0).cast("long").alias("n")))

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        c = contexts(rows["block"].iloc[0], [h for h in rows["h"] if h is not None])
        n = c["long"] - LENGTH + 1
        begin = np.cumsum(n) - n
        first = np.full(int(n.sum()), _LAST)
        for blob, k in zip(rows["c"], rows["n"]):
            if blob is not None:
                raw = _unzip(blob)
                which = np.frombuffer(raw, "<i4", k)
                m = n[which]
                first[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[which], m)] = np.frombuffer(raw, "<i8", -1, 4 * k)
        starts, text = c["starts"], np.frombuffer(c["text"], np.uint8)
        cover = np.zeros(len(text) + 1, dtype=np.int64)
        m = c["size"] - LENGTH + 1
        window = np.repeat(c["first"], m) + (inner := np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
        doc = np.repeat(c["ids"][np.searchsorted(starts, c["first"], "right") - 1], m)
        hit = np.unique(window[first[np.repeat(begin[c["which"]], m) + inner] < doc])
        cover[hit] += 1
        cover[hit + LENGTH] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        out = []
        for i in range(len(starts) - 1):
            g, t = gone[starts[i] : starts[i + 1]], text[starts[i] : starts[i + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]))).reshape(-1, 2) if g.any() else np.zeros((0, 2), int)
            kept = t[~g].tobytes() if len(edges) else t.tobytes()
            out.append((None if c["missing"][i] else int(c["ids"][i]), len(t), int(g.sum()), edges.ravel().tolist(), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "edges", "kept_sha256"]).astype({"doc_id": "Int64"})

    return told.groupBy("block").applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, edges array<long>, kept_sha256 string")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("edges") / 2).cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op4_repeats": op4_repeats}
ORACLES: dict[str, str] = {}
