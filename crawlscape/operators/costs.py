"""Size and politeness accounting: measured, projected, compared."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAIVE_BITS = 128


def region_costs(files: DataFrame, urls: int) -> DataFrame:
    """Bytes per column and URL from (column, bytes) rows of file footers."""
    n = F.lit(float(max(1, urls)))
    return files.groupBy("column").agg(F.sum("bytes").cast("long").alias("bytes")).withColumn("bytes_per_url", F.col("bytes") / n)


def projection(bits_per_url: Column, bytes_per_url: Column, urls: float, per_partition: float) -> list[Column]:
    parts = urls / per_partition
    return [
        F.lit(parts).alias("partitions"),
        (bits_per_url * urls / 8).alias("seen_bytes"),
        (bytes_per_url * urls).alias("file_bytes"),
        (bits_per_url * urls / 8 / parts).alias("seen_bytes_per_partition"),
        (bytes_per_url * urls / parts).alias("file_bytes_per_partition"),
    ]


def bloom_bits(rate: Column) -> Column:
    """The least bits per key of a Bloom filter."""
    return -F.log(rate) / F.lit(math.log(2) ** 2)


def baseline(bits_per_url: Column, rate: Column) -> list[Column]:
    return [F.lit(float(NAIVE_BITS)).alias("naive_bits"), bloom_bits(rate).alias("optimal_bits"), (F.lit(float(NAIVE_BITS)) / bits_per_url).alias("naive_ratio"), (bits_per_url / bloom_bits(rate)).alias("overhead")]


def polite_ceiling(hosts: DataFrame, delay: str = "crawl_delay") -> DataFrame:
    """(hosts, summed, median): dispatches per second that all delays (deciseconds) allow, and the rate of the
    upper median delay. Delays are counted before they are sorted: there are at most 65535 of them."""
    counts = hosts.where(F.col(delay) > 0).groupBy(F.col(delay).alias("d")).agg(F.count("*").alias("n"))
    below = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(below)).withColumn("total", F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("d")))
    return ranked.agg(F.coalesce(F.max("total"), F.lit(0)).alias("hosts"), F.coalesce(F.sum(F.col("n") * 10.0 / F.col("d")), F.lit(0.0)).alias("summed"), (10.0 / middle).alias("median"))


def polite_curve(hosts: DataFrame, delay: str = "crawl_delay") -> DataFrame:
    """(k, rate): summed rate of the k fastest hosts at k = 1, 10, 100, ... and all of them."""
    counts = hosts.where(F.col(delay) > 0).groupBy(F.col(delay).alias("d")).agg(F.count("*").alias("n"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("sum", F.coalesce(F.sum(F.col("n") * 10.0 / F.col("d")).over(before), F.lit(0.0)))
    total = runs.agg(F.max(F.col("first") + F.col("n")).alias("total"))
    powers = F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.pow(F.lit(10.0), i).cast("long")), lambda k: k < F.col("total")), F.array("total")))
    ladder = total.where("total is not null").select(F.explode(powers).alias("k"))
    at = runs.join(F.broadcast(ladder), (F.col("k") > F.col("first")) & (F.col("k") <= F.col("first") + F.col("n")))
    return at.select("k", (F.col("sum") + (F.col("k") - F.col("first")) * 10.0 / F.col("d")).alias("rate"))


def rebalance_cost(hosts: DataFrame, owner: Column, self_id: int = 0) -> DataFrame:
    """Hosts, URLs, bytes and destinations of what moves; ``hosts`` has (urls, bytes)."""
    placed = hosts.withColumn("__o", owner)
    moved = F.col("__o") != self_id
    return placed.agg(F.count("*").alias("source_hosts"), F.sum("urls").alias("source_urls"), F.count_if(moved).alias("moved_hosts"), F.coalesce(F.sum(F.when(moved, F.col("urls"))), F.lit(0)).alias("moved_urls"), F.coalesce(F.sum(F.when(moved, F.col("bytes"))), F.lit(0)).alias("shipped_bytes"), F.count_distinct(F.when(moved, F.col("__o"))).alias("destinations"), (F.coalesce(F.sum(F.when(moved, F.col("bytes"))), F.lit(0)) / F.sum("bytes")).alias("moved_fraction"))


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
        if abs(n) < 1000 or unit == "PB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1000
    return ""


def report(title: str, rows: list[tuple[str, str]]) -> str:
    wide = max((len(k) for k, _ in rows), default=0)
    return "\n".join([title, *(f"  {k.ljust(wide)}  {v}" for k, v in rows)])
