"""Result folders as a stream: incremental counters per condition, exactly once, with late rows by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import storage


def stream_results(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Read a growing folder of result files under an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def condition_counts(stream: DataFrame) -> DataFrame:
    """Running counts of rows, answers and correct answers of each condition; state is one row for each condition."""
    return stream.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_total"), F.count("parsed_choice").alias("n_scored"), F.count_if(F.col("parsed_choice") == F.col("correct_option")).alias("n_correct"))


def windowed_health(stream: DataFrame, at: str, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Failures of each provider and event-time window; rows later than ``late`` are left to batch reports."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "provider").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("status") == "failure").alias("n_failed")).select(F.col("w.start").alias("window_start"), "provider", "n_total", "n_failed")


def distinct_requests(stream: DataFrame, at: str, late: str = "7 days") -> DataFrame:
    """Each request once, however often it is delivered within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["request_id"])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there into a folder beside its checkpoint and return a scan of it.

    In complete mode each batch replaces the result; else it is a part of its own, written again if the batch is repeated,
    so every row counts once. Nothing is gathered in the driver.
    """
    out, spark, schema = f"{checkpoint}-{name}", stream.sparkSession, stream.schema

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/part={number}")

    query = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    if not storage.exists(out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).select(*schema.names)
