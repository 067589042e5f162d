"""Readings, tables, reports and the prediction store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def readings_schema(measures: list[str]) -> T.StructType:
    text = [T.StructField(c, T.StringType()) for c in ("Date", "Time")]
    return T.StructType(text + [T.StructField(m, T.DoubleType()) for m in measures])


def read_readings(spark: SparkSession, path: str, measures: list[str], sep: str = ";", null: str = "?") -> DataFrame:
    """Delimited text with a header: Date and Time as text, the measures as doubles, ``null`` as NULL."""
    return spark.read.schema(readings_schema(measures)).csv(path, sep=sep, header=True, nullValue=null, enforceSchema=True)


def read_rescued(spark: SparkSession, path: str, measures: list[str], sep: str = ";", null: str = "?") -> tuple[DataFrame, DataFrame]:
    """Delimited text as read_readings() has it, and the lines that are none: (readings, quarantine).

    Readings have file and place besides: the file, and a number that rises with the line in it. A line with too few
    or too many fields, or with a measure that is no number, is in the quarantine as it is: (file, place, line).
    """
    fields = [*readings_schema(measures).fields, T.StructField("_line", T.StringType())]
    head = sep.join(f.name for f in fields[:-1])
    options = {"sep": sep, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    # Ranges of a file are partitions, lines in order inside them; places rise with the range and the line.
    place = F.shiftleft("_metadata.file_block_start", 24) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").where(F.col("value") != head)
    rows = lines.select("file", "place", "value", F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), options).alias("x"))
    bad = F.col("x._line").isNotNull()
    return rows.where(~bad).select(*[f"x.{f.name}" for f in fields[:-1]], "file", "place"), rows.where(bad).select("file", "place", F.col("value").alias("line"))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = ("series_id", "chunk"), order: tuple[str, ...] = ()) -> None:
    """Parquet as a table of the session, rows dealt by hash of keys to so many buckets and sorted inside: tables of the same keys and buckets join without a shuffle."""
    rows = df.repartition(buckets, *keys)  # a file for each bucket
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(table)


def read_bucketed(spark: SparkSession, *tables: str) -> list[DataFrame]:
    """Bucketed tables for joins and groups on their keys and any further columns; lets the session join by a part of the keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return [spark.read.table(t) for t in tables]


def parse_ts(df: DataFrame, date_col: str = "Date", time_col: str = "Time", out: str = "ts") -> DataFrame:
    """One wall-clock timestamp of day-first date and time texts."""
    text = F.concat_ws(" ", date_col, time_col)
    return df.withColumn(out, F.to_timestamp_ntz(text, F.lit("d/M/yyyy H:mm:ss")))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; with partition columns, rows of a partition value meet in few files without one task per value."""
    if partition_cols:
        df.repartition(*partition_cols, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(mode).partitionBy(*partition_cols).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV report with a header; a byte order mark before the first name is dropped."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def save_predictions(df: DataFrame, path: str, run_id: str, mode: str) -> None:
    """Predictions of one run, replacing that run alone."""
    out = df.withColumn("mode", F.lit(mode)).withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "run_id").parquet(path)


def load_predictions(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """All runs of a mode; only that mode's folders are read."""
    return spark.read.parquet(path).where(F.col("mode") == mode)


def append_run_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def readings(events: DataFrame, key: str) -> DataFrame:
    """(series_id, ts, v): the mean value of each series and minute."""
    minute = F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")
    rows = events.select(F.col(key).cast("string").alias("series_id"), minute.alias("ts"), F.col("value"))
    return rows.groupBy("series_id", "ts").agg(F.avg("value").alias("v"))


#: What each application has written to the shared place and not deleted yet.
_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A folder for what a job writes and reads again, in the place that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/wattline-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared place and read again, and where."""
    path = scratch(spark)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that keep() has written, when nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> int:
    """Deletes all that this application has in the shared place, and tells how many folders: for when the results of its jobs are stored."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop(spark, path)
    return len(paths)
