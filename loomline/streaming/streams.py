"""Structured Streaming: capped captures, extraction of memories, event-time windows (the last are our own addition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M

MOST_CAPTURED = 1 << 20


def table_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def captured(lines: DataFrame, column: str = "value", most: int = MOST_CAPTURED) -> DataFrame:
    """Lines cut at the most characters that a capture holds, with `cut`: whether that dropped any."""
    return lines.withColumn("cut", F.length(column) > most).withColumn(column, F.substring(column, 1, most))


def extracted_once(turns: DataFrame, stamp: str, delay: str = "1 hour") -> DataFrame:
    """Memory candidates of a stream of turns (user_id, user, stamp), each normalised text once a user within the delay."""
    rows = M.valid(M.extracted(turns)).withColumn("normal", F.lower(F.regexp_replace(F.trim("user"), r"\s+", " ")))
    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["user_id", "normal"])


def windowed_usage(facts: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Commands and savings by event-time window; late rows within the delay still count."""
    windows = facts.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width))
    return windows.agg(F.count(F.lit(1)).alias("commands"), F.sum("saved_tokens").alias("saved")).select(F.col("window.start").alias("start"), "commands", "saved")


def run_once(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and gives its result as a table beside the checkpoint: of mode "append" the rows
    of all batches, of mode "complete" those of the last. A batch that is run again replaces its own rows."""
    folder, done = f"{checkpoint.rstrip('/')}-out", []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        done.append(batch)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/batch={b}" for b in (done[-1:] if mode == "complete" else done)])
