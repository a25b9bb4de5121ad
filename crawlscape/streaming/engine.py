"""The running crawl: one streaming query that admits discoveries, dispatches what is due, fetches, folds and reprices.

Admission keeps its state per host in the query's state store; pages live in a ``Store``.
A turn is one micro-batch. What it draws from the outside, admissions and fetches, is
written under its number before anything else reads it, and pages change by one commit
at its end: a turn that is repeated after a failure reads what it had and commits once.
A turn scans all pages, so that the trigger should let discoveries gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.importance import opic_score, penalised
from ..operators.importance import credit
from ..operators.outcomes import COUNTERS, apply_outcome
from ..operators.scheduling import dispatch_times, due_urls
from ..schema import SCHEDULED, Importance, Scheduler
from ..sources.store import Store
from .loop import Fetch, LogicalClock, drive, fetch_batch, use_state_store
from .processors import SEEN, intake

PAGES = ", ".join(["url STRING, host STRING, depth BIGINT, cash DOUBLE, priority DOUBLE", *(f"{c} BIGINT" for c in COUNTERS)])
FETCHED = "url string, at long, seq long, status long, not_modified boolean, redirect boolean, retryable boolean, fp long, sim long"
TURNS = 20  # bits of the number of a turn within a batch


def apply_outcomes(pages: DataFrame, fetched: DataFrame, s: Scheduler = Scheduler()) -> DataFrame:
    """Pages that were fetched, after their one outcome each; ``at`` is in hours."""
    event = F.struct(*[c.split()[0] for c in FETCHED.split(", ")])
    rows = pages.join(fetched.select("url", event.alias("__e")), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for a in rows:
                apply_outcome(a, _Event(a.pop("__e")), s)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([f for f in batch.schema if f.name != "__e"]))

    return rows.select(*pages.columns, "__e").mapInArrow(run, pages.schema)


class _Event:
    def __init__(self, fields: dict):
        self.__dict__.update(fields)


class Crawl:
    """``fetch`` gets a page's url, host, depth and counters as a dict and returns its outcome: a status and, where
    known, not_modified, redirect, retryable, fp and sim. ``delay`` is a host's in deciseconds."""

    def __init__(self, spark: SparkSession, root: str, fetch: Fetch, delay: int = 10, parallel: int = 8, s: Scheduler = Scheduler(), checkpoint_every: int = 16):
        self.spark, self.root, self.fetch, self.delay, self.parallel, self.s, self.every = spark, root.rstrip("/"), fetch, delay, parallel, s, checkpoint_every
        self.store = Store(spark, f"{self.root}/pages", "url", PAGES)
        self.clock = LogicalClock(3600 * (self.pages().agg(F.max("last_crawled")).head()[0] or 0))

    def pages(self) -> DataFrame:
        return self.store.rows()

    def dispatched(self) -> DataFrame:
        """Everything that was fetched so far: (url, host, at in seconds, ...)."""
        return self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema(f"{FETCHED}, host string, second long").parquet(f"{self.root}/fetched")

    def _once(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table unless a former try wrote the whole of it."""
        path, fs = self.store._path(f"../{name}/_SUCCESS")
        if not fs.exists(path):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _requests(self, pages: DataFrame) -> DataFrame:
        """Due pages in their hosts' turns, by the second at which they may leave."""
        due = due_urls(pages, F.lit(self.clock.now // 3600), []).withColumn("delay", F.lit(self.delay))
        return dispatch_times(due, "host", "delay", "priority", "url", self.clock.now).withColumnRenamed("at", "second")

    def _fetched(self, requests: DataFrame) -> DataFrame:
        fetch, names = self.fetch, [c.split()[0] for c in FETCHED.split(", ")]
        blank = dict.fromkeys(names, 0) | {"not_modified": False, "redirect": False, "retryable": False}

        def one(r: dict) -> dict:
            return blank | dict(fetch(r)) | {"url": r["url"], "host": r["host"], "second": r["second"], "at": r["second"] // 3600, "seq": r["rn"]}

        return fetch_batch(requests, one, f"{FETCHED}, host string, second long", self.parallel)

    def turn(self, admitted: DataFrame, number: int, part: int = 0) -> int:
        """One round over all pages; returns how many were fetched. A turn that was committed does nothing."""
        lsn = (number << TURNS) + part
        if self.store._pointer()["lsn"] >= lsn:
            return 0
        rows = self._once(admitted, f"admitted/{lsn}")
        known = self.pages()
        start = {c: F.lit(0).cast("long") for c in COUNTERS} | {"status": F.col("status").cast("long")}
        fresh = rows.where(F.col("status") != SEEN).select("url", "host", F.col("depth").cast("long").alias("depth"), F.col("weight").alias("cash"), F.lit(0.0).alias("priority"), *[c.alias(k) for k, c in start.items()])
        cash = credit(rows.where(F.col("status") == SEEN), "url", "weight").withColumnRenamed("cash", "__more")
        both = known.withColumn("__new", F.lit(False)).unionByName(fresh.withColumn("__new", F.lit(True))).join(cash, "url", "left")
        worth = penalised(opic_score(F.lit(0.0), F.col("cash"), F.lit(0.0), self.s.importance), F.lit(False), F.col("depth"), self.s.importance)
        priced = both.withColumn("cash", F.col("cash") + F.coalesce("__more", F.lit(0.0))).withColumn("__changed", F.col("__new") | F.col("__more").isNotNull())
        priced = self._once(priced.withColumn("priority", F.when(F.col("__changed"), F.least(worth, F.lit(1.0))).otherwise(F.col("priority"))).drop("__new", "__more"), f"priced/{lsn}")
        fetched = self._once(self._fetched(self._requests(priced)), f"fetched/{lsn}")
        pages = priced.drop("__changed")
        after = apply_outcomes(pages, fetched, self.s)
        rest = priced.where("__changed").drop("__changed").join(fetched.select("url"), "url", "left_anti")
        self.store.append(after.unionByName(rest).select(F.lit(lsn).cast("long").alias("lsn"), F.lit("put").alias("op"), *pages.columns))
        for name in ("admitted", "priced"):  # the commit holds what they brought
            path, fs = self.store._path(f"../{name}/{lsn}")
            fs.delete(path, True)
        done, last = fetched.agg(F.count("*"), F.max("second")).head()
        self.clock.sleep_until(last or 0)
        if len(self.store._pointer()["log"]) >= self.every:
            self.store.checkpoint()
        return done

    def start(self, discoveries: DataFrame, depth_cap: int = 0, once: bool = True) -> StreamingQuery:
        """``discoveries`` streams (url, host, src_host, depth, seq, link_weight), canonical."""
        use_state_store(self.spark)
        return drive(intake(discoveries, depth_cap, self.s.importance, rediscovered=True), lambda df, n: self.turn(df, n + 1), f"{self.root}/checkpoint", once)

    def drain(self, until: int) -> int:
        """Turns without discoveries, the clock jumping from one due hour to the next, up to the hour ``until``;
        returns how many pages were fetched."""
        total = 0
        while True:
            live = due_urls(self.pages(), F.lit(until), [])
            first = live.agg(F.min("next_due")).head()[0]
            if first is None:
                return total
            self.clock.sleep_until(first * 3600)
            lsn = self.store._pointer()["lsn"] + 1
            nothing = self.spark.createDataFrame([], "host STRING, url STRING, seq BIGINT, url_count BIGINT, url_budget BIGINT, status INT, depth BIGINT, weight DOUBLE")
            total += self.turn(nothing, lsn >> TURNS, lsn & ((1 << TURNS) - 1))
