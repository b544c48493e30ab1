"""Transcripts as streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import accumulate_partials


def backlog_then_live(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Everything stored so far in arrival order, then whatever is added: one checkpointed stream."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("latestFirst", False).format(fmt).load(folder))


def accumulate_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Store the text events of a stream so that blocks can be settled at any moment.

    Deltas of one block within a micro-batch are joined before they are stored, which keeps what has to
    be read later close to the size of the text itself.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        delta = F.col("kind").isin("text_delta", "reasoning_delta")
        finals = batch.where(F.col("kind").isin("message", "reasoning")).select("session", "msg_id", "block", "kind", "seq", "text", "chunk")
        joined = batch.where(delta).groupBy("session", "msg_id", "block", "kind").agg(
            F.min("seq").alias("seq"), F.max("seq").alias("_last"), F.count("*").alias("_n"),
            F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("_parts"))
        # parts stay apart unless the batch holds an unbroken run of them
        whole = (F.col("_last") - F.col("seq") + 1) == F.col("_n")
        merged = joined.where(whole).select("session", "msg_id", "block", "kind", "seq", F.lit(None).cast("string").alias("text"),
                                            F.array_join(F.transform("_parts", lambda x: x["chunk"]), "").alias("chunk"))
        loose = joined.where(~whole).select("session", "msg_id", "block", "kind", F.explode("_parts").alias("_p")).select(
            "session", "msg_id", "block", "kind", "_p.seq", F.lit(None).cast("string").alias("text"), "_p.chunk")
        finals.unionByName(merged).unionByName(loose).write.mode("overwrite").parquet(os.path.join(folder, f"batch={batch_id}"))
    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return accumulate_partials(spark.read.parquet(folder))
