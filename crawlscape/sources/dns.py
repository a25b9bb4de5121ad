"""Name resolution as a dimension table: bounded lifetimes, failures, address forms."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Resolver


def cached(answers: DataFrame, now: int, r: Resolver = Resolver()) -> DataFrame:
    """(host, ip, expiry, suppressed, failures) from lookups (host, at, ip, ttl): the last answer counts, its
    lifetime is bounded; a failed last lookup suppresses the host for a while; failures count since the last success."""
    turn = Window.partitionBy("host").orderBy("at")
    runs = answers.withColumn("__i", F.sum(F.when(F.col("ip").isNotNull(), 1).otherwise(0)).over(turn))
    last = runs.groupBy("host", "__i").agg(F.max("at").alias("at"), F.max_by("ip", F.when(F.col("ip").isNotNull(), F.col("at"))).alias("ip"), F.max_by("ttl", F.when(F.col("ip").isNotNull(), F.col("at"))).alias("ttl"), F.max(F.when(F.col("ip").isNotNull(), F.col("at"))).alias("good"), F.count_if(F.col("ip").isNull()).alias("failures"))
    newest = last.groupBy("host").agg(F.max_by(F.struct("at", "ip", "ttl", "good", "failures"), "__i").alias("l"))
    ttl = F.least(F.greatest(F.col("l.ttl"), F.lit(r.min_ttl)), F.lit(r.max_ttl))
    return newest.select("host", "l.ip", (F.col("l.good") + ttl).alias("expiry"), ((F.col("l.failures") > 0) & (F.col("l.at") + r.negative_ttl > now)).alias("suppressed"), "l.failures")


def resolve(hosts: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """Adds the address of hosts whose answer is still alive."""
    alive = names.where(F.col("expiry") > now).select("host", "ip")
    return hosts.join(alive, "host", "left")


def stats(names: DataFrame, now: int) -> DataFrame:
    return names.agg(F.count_if(F.col("expiry") > now).alias("live"), F.count_if("suppressed").alias("suppressed"), F.count("*").alias("known"))


def ip_bytes(text: Column) -> Column:
    """16 bytes; IPv4 addresses in their mapped form."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                a = ipaddress.ip_address(v)
            except ValueError:
                return None
            return (b"\0" * 10 + b"\xff\xff" + a.packed) if a.version == 4 else a.packed

        return values.map(one, na_action="ignore")

    return pack(text)


def ip_text(address: Column) -> Column:
    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        def one(v):
            a = ipaddress.IPv6Address(bytes(v))
            return str(a.ipv4_mapped or a)

        return values.map(one, na_action="ignore")

    return show(address)
