"""The hourly roll-up as a stream: minutes arrive in files, hours are kept up to date by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTES = "series_id string, ts timestamp_ntz, v double, impute_flag int"


def read_minutes(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the minutes in the Parquet files of a folder, those that came first first."""
    return spark.readStream.schema(MINUTES).option("maxFilesPerTrigger", files_at_once).parquet(path)


def hours(minutes: DataFrame, late: str = "2 hours", points: int = 60) -> DataFrame:
    """kw, kwh and impute_flag of complete hours (NULL for others) and n_valid_min, of minutes at most ``late`` behind the latest one.

    Minutes that come later than that are dropped, and the state of hours that can't change any more with them.
    """
    timed = minutes.withColumn("ts", F.col("ts").cast("timestamp"))  # wall-clock times; a watermark wants instants
    rows = timed.withWatermark("ts", late).groupBy("series_id", F.window("ts", "1 hour").alias("w"))
    rows = rows.agg(F.avg("v").alias("kw"), (F.sum("v") / 60).alias("kwh"), F.max("impute_flag").alias("impute_flag"), F.count("v").alias("n_valid_min"))
    full = F.col("n_valid_min") == points
    return rows.select("series_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), *[F.when(full, F.col(c)).alias(c) for c in ("kw", "kwh", "impute_flag")], "n_valid_min")


def write_hours(rolled: DataFrame, path: str, checkpoint: str):
    """Runs the stream over all files that are there, and ends. Each batch's changed hours are a folder of its own, so that a batch that runs again replaces itself."""

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = rolled.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_hours(spark: SparkSession, path: str) -> DataFrame:
    """Each hour as the last batch that changed it has it."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("batch", "series_id", "ts")]
    last = rows.groupBy("series_id", "ts").agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select("series_id", "ts", "x.*")
