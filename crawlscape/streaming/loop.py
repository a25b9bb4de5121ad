"""The crawl loop as micro-batches: intake, schedule, fetch, fold, checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.freshness import tau_step

Fetch = Callable[[dict], dict]


class LogicalClock:
    """Time that jumps to the next event."""

    def __init__(self, start: int):
        self.now = start

    def sleep_until(self, at: int) -> int:
        self.now = max(self.now, at)
        return self.now


def fetch_batch(requests: DataFrame, fetch: Fetch, schema: str, parallel: int) -> DataFrame:
    """Applies a user's fetcher to each request; as many run at once as there are partitions."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([fetch(r) for r in pdf.to_dict("records")], columns=names)

    return requests.repartition(parallel).mapInPandas(run, schema)


def requests(due: DataFrame, hosts: DataFrame) -> DataFrame:
    """Conditional requests: what a fetcher needs of a page and its host."""
    return due.join(hosts.select("host_key", "resolved_ip"), "host_key").select("host_key", "path_key", F.col("url").alias("canonical_url"), "etag", "last_modified", "resolved_ip", "depth", F.lit(False).alias("robots"))


class WaterLevel:
    """The freshness budget's water level, moved once for each tick by the scheduled rate."""

    def __init__(self, budget: float, tau: float = 1e-6):
        self.budget, self.tau, self.ticks = budget, tau, 0

    def tick(self, scheduled: DataFrame, interval: str = "interval") -> float:
        rate = scheduled.agg(F.sum(1 / F.col(interval))).head()[0] or 0.0
        self.tau, self.ticks = tau_step(self.tau, rate, self.budget), self.ticks + 1
        return self.tau


def drive(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``step(batch, number)`` on every micro-batch; a batch is repeated after a failure, under its number,
    so that a step that writes to a path of that number is applied once."""
    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
