"""Registrable domains by a public suffix list, a text file of rules whose path is a parameter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    def one(name: str | None) -> str | None:
        try:
            return name and name.encode("idna").decode()
        except UnicodeError:
            return name

    return names.map(one)


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind) of every rule: ``plain``, ``any`` (one label more, whichever it is) or ``except``, names in lower case and ASCII form.

    Comments and what follows a rule's first blank are left out."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    lines = spark.read.text(path).select(rule.alias("rule")).where("rule <> '' and rule not like '//%'")
    kind = F.when(F.col("rule").startswith("!"), "except").when(F.col("rule").startswith("*."), "any").otherwise("plain")
    name = F.regexp_replace("rule", r"^(!|\*\.)", "")
    return lines.select(F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(_ascii(name)).alias("name"), kind.alias("kind")).where("name <> '*'").distinct()


def registrable_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain) of every distinct host: the public suffix and one label more.

    The longest rule decides, an exception before all others; without one the last label is the suffix. A host that
    is a suffix, and an address, stay as they are; null has no row. Each host meets the rules by its few suffixes, in
    a join that the optimizer sizes."""
    known = hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("host")).distinct()
    clean = F.regexp_replace(F.lower("host"), r"\.$", "")
    split = known.withColumn("__clean", clean).withColumn("__labels", F.split("__clean", r"\."))
    n = F.size("__labels")
    tail = lambda k: F.array_join(F.slice("__labels", n - k + 1, k), ".")
    tries = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(
        F.struct(tail(k).alias("name"), F.lit("plain").alias("kind"), k.alias("size"), F.lit(0).alias("rank")),
        F.struct(tail(k).alias("name"), F.lit("except").alias("kind"), (k - 1).alias("size"), F.lit(1).alias("rank")),
        F.struct(tail(k).alias("name"), F.lit("any").alias("kind"), F.least(k + 1, n).alias("size"), F.when(k < n, 0).alias("rank")),
    )))
    matched = split.select("host", F.explode(tries).alias("t")).select("host", "t.*").where("rank is not null").join(rules, ["name", "kind"])
    best = matched.groupBy("host").agg(F.max(F.struct("rank", "size")).alias("best"))
    size = F.coalesce("best.size", F.lit(1))
    domain = F.array_join(F.slice("__labels", F.greatest(n - size, F.lit(1)), n), ".")
    address = F.col("__clean").rlike(r"^[0-9.]+$") | F.col("__clean").contains(":")
    return split.join(best, "host", "left").select("host", F.when(address, F.col("__clean")).otherwise(domain).alias("domain"))
