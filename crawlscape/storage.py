"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse, which a cluster shares too."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def bounded_batches(df: DataFrame, rows: int = 2000) -> None:
    """Arrow batches of whole texts of at most ``rows`` rows, unless the session asks for fewer: the default
    of 10,000 holds several copies of 10,000 texts in every task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


def cutter(spark: SparkSession, label: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table and reads it again, so that iterations don't pile up their plans and a
    lost executor costs one round."""
    root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return keep
