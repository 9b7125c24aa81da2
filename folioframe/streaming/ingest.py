"""Streams: mail that arrives, windows over events, and a run's progress as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import schema
from ..sources.mailbox import SUFFIXES, _rows, DDL

TERMINAL = ("run_done", "error")


def mail_stream(spark: SparkSession, folder: str, late: str = "14 days") -> DataFrame:
    """New messages of files that arrive in a folder, each id once within the watermark."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES)
    rows = files.where(wanted).select("path", "content").mapInPandas(_rows, DDL["emails"] + ", _path string, _at bigint")
    return rows.withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["message_id"]).drop("_path", "_at")


def windowed_counts(events: DataFrame, at: str, by: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum by window and key; late rows count until the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schema("events")).parquet(folder)


def replay(events: DataFrame, run_id: str, after: int = -1) -> DataFrame:
    """A run's events in order, up to its terminal one: what a late subscriber is sent."""
    own = events.where((F.col("run_id") == run_id) & (F.col("seq") > after))
    upto = own.where(F.col("kind").isin(*TERMINAL)).agg(F.min("seq").alias("last"))
    return own.join(F.broadcast(upto)).where(F.col("last").isNull() | (F.col("seq") <= F.col("last"))).drop("last").orderBy("seq")


def recent(events: DataFrame, run_id: str, most: int = 50) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy(F.col("seq").desc()).limit(most).orderBy("seq")


def progress(events: DataFrame) -> DataFrame:
    """Each run and stage: its state after the last event."""
    w = Window.partitionBy("run_id", "stage").orderBy(F.col("seq").desc())
    return events.where("stage is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("run_id", "stage", "kind", "seq", "payload")


def polled(events: DataFrame, at: str, seconds: int = 5) -> DataFrame:
    """What a client that asks every few seconds is shown: the events so far at the end of each interval that had any."""
    n = events.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    day = F.to_date("start")
    told = n.select(F.col("w.start").alias("start"), "n").withColumn("_day", day)
    days = told.groupBy("_day").agg(F.sum("n").alias("_d")).withColumn("_before", F.coalesce(F.sum("_d").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_d")
    upto = F.sum("n").over(Window.partitionBy("_day").orderBy("start"))
    return told.withColumn("_upto", upto).join(F.broadcast(days), "_day").select("start", "n", (F.col("_before") + F.col("_upto")).alias("so_far"))
