"""Distances over graphs cut into parts of consecutive node numbers: no task holds more than one part.

Each part finds the distances of its own nodes, and tells every part next to it those of the nodes that edges lead from.
A part whose neighbours have told it less than before goes again, until none is told less. Nodes are numbered along
their places, so most edges stay inside a part, and rounds go with the parts that a way crosses, not with its edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import release, stage

#: Node numbers of a part.
PART = 65_536
_ARC = np.dtype([("a", "<i8"), ("b", "<i8"), ("w", "<f8")])
_LABEL = np.dtype([("node", "<i8"), ("distance", "<f8")])


def spread(arcs: dict[int, list[tuple[int, float]]], start: list[tuple[float, int]]) -> dict[int, float]:
    """Distance of every node that arcs reach from the start nodes, each of which has a distance already."""
    done: dict[int, float] = {}
    heapq.heapify(start)
    while start:
        d, node = heapq.heappop(start)
        if node not in done:
            done[node] = d
            for to, w in arcs.get(node, ()):
                if to not in done:
                    heapq.heappush(start, (d + w, to))
    return done


def _packed(edges: DataFrame, sources: DataFrame, key: str, part: int) -> DataFrame:
    """(aoi_id, part, arcs, starts, near): a row for each part: arcs from its nodes, its sources, and the parts next to it."""
    arc = lambda a, b: edges.select(key, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col("length_m").cast("double").alias("w"))
    own = sources.select(key, F.col("node_id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0.0).alias("w"))
    rows = arc("u", "v").unionByName(arc("v", "u")).unionByName(own).withColumn("part", F.floor(F.col("a") / part))
    kind = dict(edges.dtypes)[key]

    def pack(t: pa.Table) -> pa.Table:
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        own = t.column("b").is_null().to_numpy()
        found = np.zeros((~own).sum(), _ARC)
        found["a"], found["b"], found["w"] = a[~own], b[~own], w[~own]
        number = t.column("part")[0].as_py()
        near = np.setdiff1d(found["b"] // part, [number])
        names = pa.schema([(key, t.schema.field(key).type), ("part", pa.int64()), ("arcs", pa.binary()), ("starts", pa.binary()), ("near", pa.list_(pa.int64()))])
        return pa.table([[t.column(key)[0].as_py()], [number], [found.tobytes()], [np.unique(a[own]).astype("<i8").tobytes()], [near.tolist()]], schema=names)

    return rows.groupBy(key, "part").applyInArrow(pack, f"{key} {kind}, part long, arcs binary, starts binary, near array<long>")


def _solved(number: int, part: int, arcs: bytes, starts: bytes, told: list[bytes]) -> tuple[dict[int, float], np.ndarray]:
    """(distances of the part's own nodes, its arcs) from its sources and what other parts have told."""
    every = np.frombuffer(arcs, _ARC)
    home = every["b"] // part == number
    inner: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in every[home].tolist():
        inner.setdefault(a, []).append((b, w))
    known: dict[int, float] = {}
    for blob in told:
        known.update(np.frombuffer(blob, _LABEL).tolist())
    start = [(0.0, s) for s in np.frombuffer(starts, "<i8").tolist()]
    start += [(known[b] + w, a) for a, b, w in every[~home].tolist() if b in known]
    return spread(inner, start), every


def distances(edges: DataFrame, sources: DataFrame, key: str = "aoi_id", part: int = PART) -> DataFrame:
    """(aoi_id, node_id, distance) from the nearest source, for nodes that can be reached.

    edges (aoi_id, u, v, length_m) go both ways, lengths are not negative; sources (aoi_id, node_id) may lie off all edges.
    """
    parts = stage(_packed(edges, sources, key, part))
    kind = dict(edges.dtypes)[key]
    schema = f"{key} {kind}, part long, to long, labels binary"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for area, number, arcs, starts, told in zip(*(b.column(k).to_pylist() for k in range(5))):
                found, every = _solved(number, part, arcs, starts, told or [])
                away = every["b"] // part
                into: dict[int, dict[int, float]] = {}
                for a, to in zip(every["a"].tolist(), away.tolist()):
                    if to != number and a in found:
                        into.setdefault(to, {})[a] = found[a]
                if into:
                    blobs = [np.array(sorted(x.items()), _LABEL).tobytes() for x in into.values()]
                    n = len(blobs)
                    yield pa.RecordBatch.from_arrays([pa.array([area] * n, b.column(0).type), pa.array([number] * n), pa.array(list(into)), pa.array(blobs, pa.binary())], [key, "part", "to", "labels"])

    def with_told(some: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            rows = some.withColumn("told", F.lit(None).cast("array<binary>"))
        else:
            rows = some.join(labels.groupBy(key, F.col("to").alias("part")).agg(F.collect_list("labels").alias("told")), [key, "part"], "left")
        return rows.select(key, "part", "arcs", "starts", "told")

    labels = stage(with_told(parts, None).mapInArrow(tell, schema))
    news = labels
    while not news.isEmpty():
        asked = news.select(key, F.col("to").alias("part")).distinct()
        again = stage(with_told(parts.join(asked, [key, "part"], "left_semi"), labels).mapInArrow(tell, schema))
        before = labels.withColumnRenamed("labels", "old")
        news = stage(again.join(before, [key, "part", "to"], "left").where("old IS NULL OR labels != old").select(key, "part", "to", "labels"))
        merged = stage(labels.join(news.select(key, "part", "to"), [key, "part", "to"], "left_anti").unionByName(news))
        release(again, labels)
        labels = merged

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for area, number, arcs, starts, told in zip(*(b.column(k).to_pylist() for k in range(5))):
                found, _ = _solved(number, part, arcs, starts, told or [])
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([area] * n, b.column(0).type), pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], [key, "node_id", "distance"])

    return with_told(parts, labels).mapInArrow(emit, f"{key} {kind}, node_id int, distance double")
