"""The tables at hand read as crawl data: pages, captures, links and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str) -> Column:
    """Whole hours since the epoch, whatever the session's zone."""
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))").cast("long")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures: a customer is a page, the status its digest, the price its importance."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url_id"), F.col("o_orderkey").alias("seq"), hours("o_orderdate").alias("hour"), F.col("o_orderstatus").alias("digest"), (F.col("o_totalprice") / 500000).alias("importance"))


CAPTURES = "SELECT o_custkey AS url_id, o_orderkey AS seq, CAST(floor(epoch(o_orderdate) / 3600) AS BIGINT) AS hour, o_orderstatus AS digest, o_totalprice / 500000 AS importance FROM orders"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as links between fifty hosts, in the order of their keys."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("src_host"), (F.col("l_partkey") % 50).alias("dst_host"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"), (F.col("l_linenumber") % 7).cast("long").alias("depth"))


LINKS = "SELECT l_suppkey % 50 AS src_host, l_partkey % 50 AS dst_host, l_orderkey AS src, l_partkey AS dst, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, CAST(l_linenumber % 7 AS BIGINT) AS depth FROM lineitem"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes: a user is a host, the type a status, the value a latency."""
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "signup", 304).when(kind == "purchase", 301).otherwise(200).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), hours("ts").alias("at"), status.alias("status"), F.floor(F.col("value") * 10).cast("long").alias("latency"), F.floor("value").cast("long").alias("fp"))


OUTCOMES = "SELECT user_id AS host, event_id AS seq, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 WHEN 'purchase' THEN 301 ELSE 200 END AS BIGINT) AS status, CAST(floor(value * 10) AS BIGINT) AS latency, CAST(floor(value) AS BIGINT) AS fp FROM events"
