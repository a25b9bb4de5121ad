"""Capture listings: line-delimited JSON with one crawl capture per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, host_of
from ..schema import CAPTURES


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All lines with ``skipped``: not parsable, or without URL or host. Blank lines are no lines."""
    raw = spark.read.schema(CAPTURES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    host = F.coalesce(F.nullif("host", F.lit("")), host_of(F.col("url")))
    rows = raw.withColumn("host", host).withColumn("hours", F.floor(F.unix_timestamp(F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss"))) / 3600).cast("int"))
    bad = F.col("_corrupt_record").isNotNull() | F.coalesce(F.col("url") == "", F.lit(True)) | F.coalesce(F.col("host") == "", F.lit(True))
    return rows.withColumn("skipped", bad).drop("_corrupt_record")


def decode_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON text, as a stream delivers it."""
    parsed = lines.where(F.trim(column) != "").withColumn("__c", F.from_json(column, CAPTURES.replace(", _corrupt_record STRING", "")))
    return parsed.select("__c.*").withColumn("host", F.coalesce(F.nullif("host", F.lit("")), host_of(F.col("url"))))


def seed_discoveries(captures: DataFrame, priority: float = 0.5, seq: str = "hours") -> DataFrame:
    """First capture of every canonical URL as a seed; what can't be crawled is dropped."""
    seeds = captures.where(~F.col("skipped")).withColumn("url", canonical_url(F.col("url"))).where("url is not null")
    first = seeds.groupBy("url").agg(F.min_by(F.struct("host", seq), F.struct(seq, "host")).alias("f"))
    return first.select("url", "f.host", F.col(f"f.{seq}").alias("observed_at"), F.lit(0).alias("depth"), F.lit(0).alias("discovery_source"), F.lit(priority).cast("float").alias("link_weight"))
