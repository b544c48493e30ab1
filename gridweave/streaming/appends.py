"""Appending streams to datasets."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import append
from ..session import path_exists

BATCH = "batch"


def append_stream(stream: DataFrame, folder: str, checkpoint: str, base_schema: T.StructType, keys: Sequence[str] | None,
                  order: str = "_seq", available_now: bool = True) -> StreamingQuery:
    """Append a stream to the dataset in ``folder``, skipping rows whose key is already there.

    Every micro-batch becomes its own sub-folder and is compared with all earlier ones, so repeating a
    batch after a failure writes the same rows again instead of adding them twice.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        base = read_appended(batch.sparkSession, folder, base_schema).where(F.col(BATCH) < batch_id).drop(BATCH)
        base = base.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in base_schema.fields])
        added = append(base, batch, keys, order=order, renumber=False).added
        added.write.mode("overwrite").parquet(os.path.join(folder, f"{BATCH}={batch_id}"))

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The dataset a stream has built so far; empty before its first batch."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    if path_exists(spark, folder):
        return spark.read.schema(full).parquet(folder)
    return spark.createDataFrame([], full)
