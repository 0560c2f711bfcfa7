"""The intake engine on a stream: each micro-batch is one ordered batch of the same engine.

State lives in the stores, so nothing is forgotten as a watermark would, and a micro-batch that is run again after a failure
finds its number committed and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.intake import Intake
from strandloom.operators.late import LateHours
from strandloom.operators.ordering import with_running_sums
from strandloom.operators.redelivery import IdentifierIndex


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """NDJSON files as they appear: one raw text a line, and where it stands."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.col("value").alias("raw"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("file"))


def with_arrival(batch: DataFrame) -> DataFrame:
    """(arrival, raw) of a micro-batch without an order of its own: by file and line, so a micro-batch that is run again has
    the same order. A stream that says neither arrival nor file is taken in the order its tasks read it."""
    if "arrival" in batch.columns:
        return batch
    lines = batch.withColumn("line", F.monotonically_increasing_id())
    if "file" not in batch.columns:
        return lines.select(F.col("line").alias("arrival"), "raw")
    return with_running_sums(lines.select(F.struct("file", "line").alias("at"), "raw"), "at", {"arrival": 1}).select("arrival", "raw")


def ingest_stream(engine: Intake, stream: DataFrame, checkpoint: str, name: str = "intake", once: bool = False) -> StreamingQuery:
    """Feed a stream of raw texts (with arrival, if there is one) into ``engine``. Texts that are no JSON are rejected as
    malformed envelopes, so bad input never stops the stream."""

    def take(batch: DataFrame, number: int) -> None:
        engine.ingest(with_arrival(batch), f"{name}:{number}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_hours_stream(state: LateHours, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Feed (insert_seq, event_ms, ingested_at) into the late-corrected hours; a micro-batch run again counts once."""

    def take(batch: DataFrame, number: int) -> None:
        state.ingest(batch, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()


def exactly_once_stream(index: IdentifierIndex, stream: DataFrame, checkpoint: str, sink: str, once: bool = False) -> StreamingQuery:
    """Feed (id, arrival, ...) through an identifier index and append the rows that are no copies to ``sink``.

    A micro-batch run again gets the same answer from the index and writes the same rows over its own folder.
    """

    def take(batch: DataFrame, number: int) -> None:
        copies = index.ingest(batch.select("id", "arrival"), number).select("id", "kept")
        fresh = batch.join(copies, "id", "left").where(F.col("kept").isNull() | (F.col("kept") == F.col("arrival"))).drop("kept")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()
