"""Streaming variants of sessions and pending roll-ups over an append-only change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataflow.storage import new_path


def change_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream of its Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def session_windows(log: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started_at, ended_at, n_rows) of each session. In append mode a session is given once no row that is less than ``late`` late can change it, and its state is dropped."""
    grouped = log.withWatermark(at, late).groupBy(key, F.session_window(at, gap))
    rows = grouped.agg(F.count("*").alias("n_rows"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return rows.select(key, "started_at", "ended_at", "n_rows")


def pending_counts(log: DataFrame, key: str, actor: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows by key, actor and day: bounded state under the watermark."""
    return log.withWatermark(at, late).groupBy(key, actor, F.window(at, "1 day")).agg(F.count("*").alias("n_rows")).select(key, actor, F.to_date("window.start").alias("day"), "n_rows")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it gave.

    append: a Parquet sink with exactly-once files. complete: each batch replaces the result, for reports over a closed log.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-offsets")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
