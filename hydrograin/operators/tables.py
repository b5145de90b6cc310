"""Tables in the shared folder, and connected components by repeated joins."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders that stage() wrote within scratch(), innermost last.
_WITHIN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("within", default=None)
#: Folders of the tables that stage() returned.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder that Spark names by URI; file:, hdfs:, s3:, gs: and abfs: are known to Arrow."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not _:
        return LocalFileSystem(), "/" + (rest if _ else uri).lstrip("/")
    return FileSystem.from_uri(uri.replace("s3a:", "s3:", 1).replace("s3n:", "s3:", 1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset a temporary one, if all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hydrograin-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if (within := _WITHIN.get()) is not None:
        within.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STAGED[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of stage() that nothing will read again; one that cannot be reached is left where it is."""
    for table in tables:
        if path := _STAGED.pop(table, None):
            _delete(path)


def _delete(path: str) -> None:
    with contextlib.suppress(OSError):
        fs, folder = filesystem(path)
        fs.delete_dir(folder)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that stage() writes inside are deleted at the end: what they feed must be written elsewhere by then."""
    paths: list[str] = []
    token = _WITHIN.set(paths)
    try:
        yield
    finally:
        _WITHIN.reset(token)
        for path in paths:
            _delete(path)


def numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """df with each row's number from 0 within its key, by `order`: counted within ranges of rows, which add up, so no key has to fit into one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df.repartitionByRange(parts, key, order).withColumn("_range", F.spark_partition_id()))
    before = rows.groupBy(key, "_range").agg(F.count("*").alias("n"))
    before = before.select(key, "_range", (F.sum("n").over(W.partitionBy(key).orderBy("_range")) - F.col("n")).alias("_before"))
    at = F.row_number().over(W.partitionBy(key, "_range").orderBy(order)) - 1
    return stage(rows.withColumn("_at", at).join(before, [key, "_range"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_at", "_before", "_range"))


def _pair_hash(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b), component being the smallest node reachable.

    Alternates the large-star and small-star steps until the edge set is a forest of stars. Every
    step is a min() with map-side combine and one join; the per-node minima are dealt anew before
    that join so that AQE can split the partition of a hub.
    """
    e = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _pair_hash(e)
    while before[0]:
        last = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low.repartition(F.xxhash64("u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(low.repartition(F.xxhash64("u")), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        release(last)
        after = _pair_hash(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
