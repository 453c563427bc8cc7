"""Readers of inventories, path lists, progress logs and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.blocks import numbered

INVENTORY = "Path string, Name string, Size bigint, ModTime string, IsDir boolean, ID string"
EVENTS = "ts timestamp, profile_id string, path string, flags string"


def remote_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Remote objects of JSON listings: path, size, is_dir."""
    raw = spark.read.schema(INVENTORY).json(path)
    return raw.select(F.coalesce("Path", "Name").alias("path"), F.col("Size").alias("size"), F.coalesce("IsDir", F.lit(False)).alias("is_dir"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """Clean relative paths of text listings; what leaves the root or isn't canonical is dropped."""
    line = F.trim(F.replace(F.regexp_replace("value", r"\r$", ""), F.lit("\\"), F.lit("/")))
    clean = P.join_clean(F.lit(""), line)
    return spark.read.text(path).select(clean.alias("path")).filter(P.is_canonical("path"))


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of progress logs with their file and place in it."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_name"].alias("run_id"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("k"), m["file_modification_time"].alias("ts"), F.col("value").alias("line"))
    # a split is read in order by one task; splits of a file are numbered one after another
    return numbered(lines, "run_id", ("block", "k"), "n").select("run_id", (F.col("n") - 1).cast("long").alias("seq"), "ts", "line")


def with_flags(events: DataFrame) -> DataFrame:
    """Raw events with whole-number flags; what is no number counts as 0."""
    return events.withColumn("flags", F.coalesce(F.expr("try_cast(flags AS bigint)"), F.lit(0)).cast("long"))


def static_events(spark: SparkSession, path: str) -> DataFrame:
    """The change events that a folder of JSON files holds now."""
    return with_flags(spark.read.schema(EVENTS).json(path))


def change_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON change events below a folder."""
    return with_flags(spark.readStream.schema(EVENTS).json(path))
