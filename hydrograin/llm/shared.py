"""Helpers that several corpus operators use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import connected_components, filesystem, release, shared_folder, stage

__all__ = ["SPACE", "chunks", "connected_components", "filesystem", "let", "new_folder", "read_table", "release", "shared_folder", "spread", "stage"]

#: Tasks that a table of file names is dealt to, at most; beyond it a task reads several files in turn.
MOST_TASKS = 20_000

#: ASCII white space, the only separators of the corpus contracts.
SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    uri = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path)
    return uri


def spread(names: DataFrame) -> DataFrame:
    """A staged table of file names, a task per name: rows are small, and AQE would put all of them into one partition but for the number."""
    return names.repartition(max(1, min(names.count(), MOST_TASKS)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is named, also inside further lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(items: Column, size: int = 256) -> Column:
    """The array in arrays of at most `size`; an empty one for no items.

    A fold that appends to an array copies it each time: folds over chunks keep what is copied short.
    """
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, size))
