"""Solve frames as they arrive in a folder, and solve rates of a log stream by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import solve

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_frames(spark: SparkSession, folder: str, stars: DataFrame, out: str, checkpoint: str, nside: int = 64, files_per_batch: int = 64):
    """Start a query that solves new image files and appends their outcomes as Parquet.

    Exactly once per file: the file source's log tells new files from old, and a batch that is
    run again overwrites its own folder.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.fit*").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        solve.solve_frames(batch.select("path", "content"), stars, nside).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def solve_rate_by_window(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Attempts and solves per rig and window of a streaming log; rows later than the watermark are dropped."""
    solved = F.coalesce(F.col("outcome.solved"), F.lit(False))
    return (
        log.withColumn("run_at", F.col("run_at").cast("timestamp"))
        .withWatermark("run_at", late)
        .dropDuplicatesWithinWatermark(["log_id"])
        .groupBy(F.window("run_at", window), "rig")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(solved).alias("solved"))
        .select(F.col("window.start").alias("start"), "rig", "n", "solved")
    )
