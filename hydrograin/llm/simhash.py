"""SimHash fingerprints and their exact near pairs through a forest of vantage-point trees.

Fingerprints are cut into blocks. If two fingerprints differ in at most R bits and the block radii
r satisfy sum(r + 1) > R, some block differs in at most r bits, so one tree per block with the small
radius r finds every pair; each hit is then checked on all bits. With 64 bits, two blocks of 32 bits
and r = 1 are exact for R = 3.

A tree splits the points of a node by their Hamming distance d to the node's vantage point: inside
where d <= t, outside where d > t. By the triangle bound a point inside can only have a partner
outside if d > t - r, and only then the point is also sent to the outer shard. That one-sided overlap
is enough: a pair split by a node meets again in its outer child, so any pair within r shares a leaf.

deduplicated() uses the same trees on wider fingerprints of shingle sets: there each tree brings together the pairs
whose own block differs in at most r bits, a stretch of further bits sorts out the unlike ones, and the links that
remain are checked on the shingle sets themselves.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import connected_components, filesystem, new_folder, read_table, release, stage

#: (first bit, bits, radius) of each tree: exact for 3 differing bits of 64.
BLOCKS_64 = ((0, 32, 1), (32, 32, 1))
#: 24 trees over 576 bits: at a similarity of 0.8 a block differs in 1 bit or none with a chance of 0.10, and so one of
#: 24 does with 0.93; at 0.85 with 0.99. STRETCH: bits that are compared in a leaf, from the block's own on.
WIDE_BLOCKS, BITS, STRETCH, WIDE_SHARD, WIDE_CHUNK = tuple((24 * k, 24, 1) for k in range(24)), 576, 160, 1 << 20, 1 << 21
#: Fingerprints that a shard aims at, and the most that one side of a comparison holds.
LEAF, CHUNK = 4_096, 16_384
#: Shards above this grow on as trees inside their task, until leaves have as many points or DEEPEST levels are reached.
WITHIN, DEEPEST = 1_024, 60
#: The list of leaves over CHUNK is broadcast up to this many rows; with more of them the trees grow deeper.
BROADCAST_LEAVES = 500_000
#: What a level leaves of a shard, overlaps included, for evenly spread fingerprints.
SHRINK = 0.58

def _mix(x: np.ndarray) -> np.ndarray:
    """Vectorised 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each 64 bits of a wide fingerprint; the first two also name vantage points.
with np.errstate(over="ignore"):
    _ODD = _mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def majority(h: np.ndarray) -> bytes:
    """Of each bit column of the rows of h (n x k unsigned integers) whether over half are set, as big-endian bytes.

    Of many rows three at a time are added up into a sum and a carry, all 64 columns of a word at once.
    """
    n, total, weight, rows = len(h), np.zeros(64 * h.shape[1], dtype=np.int64), 1, h
    while len(rows):
        carries = []
        while len(rows) > 1024:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            either = a ^ b
            carries.append((a & b) | (either & c))
            rows = np.concatenate([either ^ c, rows[3 * k :]])
        total += weight * np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1).sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return np.packbits(total * 2 > n).tobytes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` lower-cased words, in order; of all words where there are fewer."""
    words = (text or "").encode().lower().split()
    if len(words) > width:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)))]
    else:
        grams = [b" ".join(words)] if words else []
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=len(grams))


def wide(h: np.ndarray, n_bits: int) -> bytes:
    """Big-endian SimHash of n_bits of the hashes; zero for none."""
    if not len(h):
        return bytes(n_bits // 8)
    with np.errstate(over="ignore"):
        return majority(h[:, None] if n_bits == 64 else _mix(h[:, None] * _ODD[None, : n_bits // 64]))


def fingerprint(text: str | None, shingle: int, n_bits: int = 64) -> bytes:
    """Big-endian SimHash of one text; see fingerprints()."""
    return wide(shingles(text, shingle), n_bits)


def fingerprints(docs: DataFrame, shingle: int = 3, n_bits: int = 64) -> DataFrame:
    """(doc_id, fp BINARY) of each row: words split at ASCII white space, A-Z lower-cased, shingles repeated.

    A null text counts as empty; a text without words has the zero fingerprint; one of fewer words
    than a shingle is hashed whole. Other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, n_bits) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp binary")


def _block(octets: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Bits first..first+bits of each row of octets, as unsigned integers."""
    part = np.zeros(len(octets), dtype=np.uint64)
    for k in range(first // 8, (first + bits) // 8):
        part = (part << np.uint64(8)) | octets[:, k].astype(np.uint64)
    return part


def _vantage(node: np.ndarray, tree: int, bits: int) -> np.ndarray:
    """Vantage points of nodes."""
    with np.errstate(over="ignore"):
        return _mix(node * _ODD[0] + np.uint64(tree + 1) * _ODD[1]) & np.uint64((1 << bits) - 1)


def route(points: np.ndarray, tree: int, bits: int, radius: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every shard that the points belong to in a tree of the given depth."""
    row, node, t = np.arange(len(points)), np.ones(len(points), dtype=np.uint64), bits // 2
    for _ in range(depth):
        d = np.bitwise_count(points[row] ^ _vantage(node, tree, bits)).astype(np.int16)
        inside, outside = d <= t, d > t - radius
        row = np.concatenate([row[inside], row[outside]])
        node = np.concatenate([node[inside] << np.uint64(1), (node[outside] << np.uint64(1)) | np.uint64(1)])
    return row, node


def grown(points: np.ndarray, tree: int, bits: int, radius: int, node: int, depth: int) -> Iterator[np.ndarray]:
    """Rows of each leaf of the tree below a node at that depth, one leaf at a time, of WITHIN points or fewer if the points allow.

    The same overlap as in route(): near points share a leaf. Points that no vantage point parts stay together.
    """
    todo, t = [(np.arange(len(points)), node, depth)], bits // 2
    while todo:
        rows, node, depth = todo.pop()
        if len(rows) <= WITHIN or depth >= DEEPEST:
            yield rows
            continue
        d = np.bitwise_count(points[rows] ^ _vantage(np.array([node], dtype=np.uint64), tree, bits)[0]).astype(np.int16)
        todo += [(rows[d <= t], 2 * node, depth + 1), (rows[d > t - radius], 2 * node + 1, depth + 1)]


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of least weights of the edges (a, b, w) over n nodes: each part takes its least edge, until none is left."""
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    label, live, kept = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        least = np.full(n, len(a))
        np.minimum.at(least, x, live)
        np.minimum.at(least, y, live)
        chosen = np.unique(least[least < len(a)])
        kept.append(chosen)
        x, y, root = label[a[chosen]], label[b[chosen]], np.arange(n)
        while True:
            new = root.copy()
            low = np.minimum(root[x], root[y])
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        label = root[label]
    at = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
    return a[at], b[at], w[at]


def _near(words: np.ndarray, side: np.ndarray, octets: np.ndarray, radius: int, most: int, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest (a, b, distance), of least distances, of the near pairs in one comparison: at most one link less than points.

    Pairs are brought down to a forest whenever there are several times as many as points.
    """
    left = np.flatnonzero(side == 0) if across else np.arange(len(words))
    right = np.flatnonzero(side == 1) if across else left
    none = np.zeros(0, dtype=np.int64)
    found, size = [(none, none, none)], 0
    step = max(16, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(words[rows][:, None] ^ words[right][None, :]) <= radius)
        i, j = rows[i], right[j]
        keep = i < j if not across else slice(None)
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            d = np.bitwise_count(octets[p] ^ octets[q]).sum(axis=1, dtype=np.int64)
            near = d <= most
            found.append((p[near], q[near], d[near]))
            size += int(near.sum())
            if size > 4 * len(words):
                found = [forest(*(np.concatenate(x) for x in zip(*found)), len(words))]
                size = 0
    return forest(*(np.concatenate(x) for x in zip(*found)), len(words))


def _links(ids: np.ndarray, side: np.ndarray, octets: np.ndarray, shard: tuple[int, int, int], bits: int, radius: int, most: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, of least distances, of the near pairs in a shard (tree, node, depth), whose tree goes on inside."""
    order = np.argsort(ids, kind="stable")
    ids, side, octets = ids[order], side[order], octets[order]
    words = _block(octets, 0, bits)
    none = np.zeros(0, dtype=np.int64)
    found, size = [(none, none, none)], 0
    for rows in grown(words, shard[0], bits, radius, *shard[1:]):
        a, b, w = _near(words[rows], side[rows], octets[rows], radius, most, across)
        found.append((rows[a], rows[b], w))
        size += len(a)
        if size > 4 * len(ids):
            found = [forest(*(np.concatenate(x) for x in zip(*found)), len(ids))]
            size = 0
    a, b, _ = forest(*(np.concatenate(x) for x in zip(*found)), len(ids))
    return ids[a], ids[b]


def near_links(points: DataFrame, blocks: tuple = BLOCKS_64, most: int = 3, stretch: int = 64, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between points (id, fp) that some tree brings together and whose `stretch` bits from that tree's
    block on, round the end, differ in `most` or fewer. With all bits in the stretch and blocks that are exact for
    `most`, the components of the links are those of all pairs at that distance.

    points: ids are distinct. They travel packed, one binary per shard and batch, to shards that aim at `leaf` points; a
    tree goes on inside its task, without sending anything. Shards above `chunk` points are compared part by part, so
    no task holds more than two parts; every comparison returns a spanning forest of the least distances, not all pairs.
    """
    width = stretch // 8
    points = points.select("id", "fp")
    depth = max(0, math.ceil(math.log(max(1, points.count()) / leaf) / -math.log(SHRINK)))

    def leaves(b: pa.RecordBatch, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, leaves, rows of the batch in them), in order of leaves."""
        octets = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
        for tree, (first, bits, radius) in enumerate(blocks):
            row, node = route(_block(octets, first, bits), tree, bits, radius, depth)
            order = np.argsort(node, kind="stable")
            yield tree, node[order].astype(np.int64), row[order]

    def large_leaves(depth: int) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, node, _ in leaves(b, depth) if b.num_rows else ():
                    at, n = np.unique(node, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, dtype=np.int32)), pa.array(at), pa.array(n)], ["tree", "node", "n"])

        counted = points.mapInArrow(count, "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
        return stage(counted.where(F.col("n") > chunk))

    large = large_leaves(depth)
    while large.count() > BROADCAST_LEAVES and depth < DEEPEST:
        depth += 1
        release(large)
        large = large_leaves(depth)
    parts = {(r["tree"], r["node"]): -(-r["n"] // chunk) for r in large.toLocalIterator()}
    release(large)
    parts = points.sparkSession.sparkContext.broadcast(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            octets = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            named = ids.astype("<i8").view(np.uint8).reshape(-1, 8)
            out: list[tuple] = []
            for tree, node, row in leaves(b, depth):
                packed = np.hstack([named, np.roll(octets, -(blocks[tree][0] // 8), axis=1)[:, :width]])
                cuts = np.flatnonzero(np.diff(node)) + 1
                for at, rows in zip(np.split(node, cuts), np.split(row, cuts)):
                    k = parts.value.get((tree, int(at[0])), 1)
                    if k == 1:
                        out.append((tree, int(at[0]), 0, 0, 0, packed[rows].tobytes()))
                        continue
                    own = ids[rows] % k
                    for c in range(k):
                        if len(mine := packed[rows[own == c]]):
                            out += [(tree, int(at[0]), min(c, o), max(c, o), int(c > o), mine.tobytes()) for o in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["tree", "node", "i", "j", "side", "blob"])

    packed = points.mapInArrow(pack, "tree int, node long, i int, j int, side int, blob binary")
    sides = packed.groupBy("tree", "node", "i", "j").agg(F.collect_list(F.struct("side", "blob")).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tree, node, i, j, rows = (b.column(c)[k].as_py() for c in range(5))
                blobs = [np.frombuffer(r["blob"], dtype=np.uint8).reshape(-1, 8 + width) for r in rows]
                side = np.concatenate([np.full(len(x), r["side"]) for x, r in zip(blobs, rows)])
                every = np.concatenate(blobs)
                if len(every) > 1:
                    ids = np.ascontiguousarray(every[:, :8]).view("<i8").ravel()
                    a, c = _links(ids, side, np.ascontiguousarray(every[:, 8:]), (tree, node, depth), *blocks[tree][1:], most, i != j)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return sides.select("tree", "node", "i", "j", "rows").mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, n_bits: int = 64, blocks: tuple = BLOCKS_64, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row, component_id being the smallest doc_id reachable over near fingerprints.

    Equal fingerprints are collapsed before the search. Repeated doc_ids keep their rows. A row whose
    doc_id is null has the component of its fingerprint, or null where no row with an id shares it.
    """
    fps = stage(fingerprints(docs, shingle, n_bits))
    points = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"))
    # One doc_id may have several texts: then its fingerprints are linked through its other point below.
    links = near_links(points.select(F.xxhash64("fp").alias("id"), "fp"), blocks, most)
    component = connected_components(links)
    keyed = points.withColumn("node", F.xxhash64("fp"))
    of_node = keyed.join(component, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("c"))
    lowest = of_node.groupBy("c").agg(F.min("id").alias("component_id"))
    by_fp = of_node.join(lowest.repartition(F.xxhash64("c")), "c").select("fp", "component_id")
    return fps.join(by_fp.repartition(F.xxhash64("fp")), "fp", "left").select("doc_id", "fp", "component_id")


def wide_distance(similarity: float, n_bits: int = STRETCH, deviations: float = 2) -> int:
    """Differing bits expected at a Jaccard similarity of shingle sets, plus some standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def sketched(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sketches), both written out: rows (row, doc STRUCT of all columns), and (row, id, set LONG, fp BINARY), the hash and the SimHash of its shingle set.

    Python sees row numbers and texts alone: other columns stay with Spark.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    texts = rows.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                names, fps = [], []
                for t in part.column(2).to_pylist():
                    h = np.unique(shingles(t, shingle))
                    names.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 7))
                    fps.append(wide(h, BITS))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(names, dtype=np.uint64).view(np.int64)), pa.array(fps, pa.binary())], ["row", "id", "set", "fp"])

    return rows, stage(texts.mapInArrow(of, "row long, id long, set long, fp binary"))


def close_links(links: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """The links (a, b) between points (set, fp) whose whole fingerprints differ in `most` bits or fewer: sets travel for these alone."""
    both = links.join(points.select(F.col("set").alias("a"), F.col("fp").alias("of_a")), "a").join(points.select(F.col("set").alias("b"), F.col("fp").alias("of_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, BITS // 8) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array(np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= most))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def picked(rows: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The rows (row, ...) whose number is among ids (row), without a shuffle of rows: they stay where they are read.

    Numbers are those of monotonically_increasing_id(): the numbers that one partition gave go to one small file in the
    folder, and a task reads the files of the partitions that its rows come from. Files appear complete or not at all,
    and a repeated task writes the same.
    """

    def write(table: pa.Table) -> pa.Table:
        fs, top = filesystem(folder)
        part = table.column("part")[0].as_py()
        with fs.open_output_stream(path := f"{top}/.{part}.{uuid.uuid4().hex}") as f:
            f.write(np.sort(table.column("row").to_numpy()).astype("<i8").tobytes())
        fs.move(path, f"{top}/{part}")
        return pa.table({"part": [part]})

    dealt = ids.select("row", F.shiftright("row", 33).alias("part"))
    stage(dealt.groupBy("part").applyInArrow(write, "part long"))

    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fs, top = filesystem(folder)
        known: dict[int, np.ndarray] = {}
        for b in batches:
            row = b.to_numpy()
            part = row >> 33
            keep = np.zeros(len(row), bool)
            for p in np.unique(part).tolist():
                if p not in known:
                    path = f"{top}/{p}"
                    there = fs.get_file_info(path).type == FileType.File
                    known = {p: np.frombuffer(fs.open_input_file(path).read() if there else b"", "<i8")}
                keep |= (part == p) & np.isin(row, known[p], kind="sort")
            yield pd.Series(keep)

    return rows.where(F.pandas_udf(among, "boolean")("row"))


def similar_links(rows: DataFrame, sketches: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between different shingle sets of rows (see sketched()), each of that Jaccard similarity or more; written out."""
    points = stage(sketches.groupBy("set").agg(F.min("row").alias("row"), F.min("fp").alias("fp")))
    near = near_links(points.select(F.col("set").alias("id"), "fp"), WIDE_BLOCKS, wide_distance(similarity), STRETCH, WIDE_SHARD, WIDE_CHUNK)
    near = stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = stage(close_links(near, points, wide_distance(similarity, BITS, 3)))
    release(near)
    ends = points.select("set", "row").join(found.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set")
    texts = picked(rows.select("row", F.col("doc.text").cast("string").alias("text")), ends, new_folder(rows.sparkSession)).select("text")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [np.unique(shingles(t, shingle)).astype("<u8").tobytes() for t in b.column(0).slice(at, 256).to_pylist()]
                names = np.array([xxhash.xxh64_intdigest(x, 7) for x in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sets, pa.binary())], ["set", "members"])

    sets = stage(texts.mapInArrow(members, "set long, members binary"))
    release(points)
    both = found.join(sets.select(F.col("set").alias("a"), F.col("members").alias("of_a")), "a")
    both = both.join(sets.select(F.col("set").alias("b"), F.col("members").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = stage(both.mapInArrow(check, "a long, b long"))
    release(sets, found)
    return links


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id, the first of these where it repeats.

    Rows are linked if their sets of word shingles have at least that Jaccard similarity; groups are what links reach.
    Candidates come from vantage-point trees over wide fingerprints; each is checked on the whole sets, so no link is
    wrong, and the share of links found is that of WIDE_BLOCKS. Texts with equal sets, null and empty ones among them, are
    copies. A null doc_id counts as larger than all others. All columns stay as they are, whatever their names.
    """
    rows, sketches = sketched(docs, shingle)
    links = similar_links(rows, sketches, shingle, similarity)
    component = connected_components(links)
    release(links)
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    first = sketches.groupBy("set").agg(F.min(order).alias("first"))
    first = first.join(component, first["set"] == component["node"], "left").select(F.coalesce("component", "set").alias("c"), "first")
    kept = first.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return picked(rows, kept, new_folder(docs.sparkSession)).select("doc.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
