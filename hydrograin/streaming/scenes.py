"""Extension: new scenes as a file stream, paired with the known ones as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import scenes

SCHEMA = "scene_id string, acquisition_time string, orbit_direction string, relative_orbit int"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)


def pair_arrivals(arrivals: DataFrame, known: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Pairs of each batch of scenes, appended to `out`; a batch that is run again replaces its own part."""

    def one(batch: DataFrame, number: int) -> None:
        scenes.pair(batch.dropDuplicates(["scene_id"]), known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
