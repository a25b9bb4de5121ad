"""Outcomes folded into page state: change counters, retries, redirects."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.politeness import apply_rate
from ..schema import CRAWLED, GONE, IN_FLIGHT, SCHEDULED, Politeness, Scheduler

COUNTERS = ["status", "retry_count", "error_count", "crawl_count", "change_count", "nochange_streak", "first_seen", "last_crawled", "last_changed", "next_due", "content_fp", "simhash", "http_status"]


def apply_outcome(a: dict, e, s: Scheduler = Scheduler()) -> None:
    """Changes the counters ``a`` of a page by one outcome (status, at, not_modified, redirect, retryable, fp, sim).

    First match: not modified or redirected pages are crawled; a retryable outcome or a status of
    400 to 599 fails; anything else is crawled. 410, or the last retry, ends in ``gone``; a gone
    page stays gone."""
    if a["status"] == GONE:
        return
    at, status = int(e.at), int(e.status)
    moved = bool(e.redirect) or 300 <= status <= 399
    a["http_status"] = status
    if not e.not_modified and not moved and (e.retryable or 400 <= status <= 599):
        a["retry_count"] = min(a["retry_count"] + 1, s.max_retries)
        a["error_count"] = min(a["error_count"] + 1, 65535)
        if status == 410 or a["retry_count"] >= s.max_retries:
            a["status"] = GONE
        else:
            a["status"], a["next_due"] = SCHEDULED, at + min(2 ** (a["retry_count"] - 1), s.recrawl_gap)
        return
    fp, sim = int(e.fp), int(e.sim)
    body = not e.not_modified and fp != 0
    known = body and a["content_fp"] != 0
    same = known and (a["content_fp"] == fp or ((a["simhash"] ^ sim) & ((1 << 64) - 1)).bit_count() <= 3)
    if known and not same:
        a["change_count"], a["nochange_streak"], a["last_changed"] = a["change_count"] + 1, 0, at
    elif same or e.not_modified:
        a["nochange_streak"] += 1
    if body:
        a["content_fp"], a["simhash"] = fp, sim
    a["first_seen"] = a["first_seen"] or at
    a.update(status=CRAWLED, retry_count=0, crawl_count=a["crawl_count"] + 1, last_crawled=at, next_due=at + s.recrawl_gap)


def new_page() -> dict:
    """Counters of a page without outcomes."""
    return {c: 0 for c in COUNTERS} | {"status": SCHEDULED}


def fold_in_order(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], None], out: str) -> DataFrame:
    """One row per key: its state after ``step`` has seen its rows in ``order``, which is distinct in a key.

    ``out`` is the schema of the state's columns. Rows are sorted in partitions by key and pass
    through in batches, with one state at a time in memory, so that a key may have any number of
    rows; rows of a null key are a key of their own."""
    names = rows.columns
    row = namedtuple("Row", names)
    at = [names.index(k) for k in key]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, schema = None, None, None
        for batch in batches:
            if schema is None:
                types = [(k, batch.schema.field(k).type) for k in key]
                states = {k: pa.float64() if isinstance(v, float) else pa.bool_() if isinstance(v, bool) else pa.int64() for k, v in start().items()}
                schema = pa.schema([*types, *states.items()])
            done = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = tuple(values[i] for i in at)
                if state is None or found != own:
                    if state is not None:
                        done.append(dict(zip(key, own, strict=True)) | state)
                    own, state = found, start()
                step(state, row._make(values))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(key, own, strict=True)) | state], schema)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, ", ".join([*fields, out]))


def fold(outcomes: DataFrame, page: list[str], s: Scheduler = Scheduler()) -> DataFrame:
    """One row per page with its counters; an outcome's order is (at, seq)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    events = outcomes.select(*page, number("at"), "seq", number("status"), flag("not_modified"), flag("redirect"), flag("retryable"), number("fp"), number("sim"))
    return fold_in_order(events, page, ["at", "seq"], new_page, lambda a, e: apply_outcome(a, e, s), ", ".join(f"{c} bigint" for c in COUNTERS))


def fold_rates(outcomes: DataFrame, host: str, p: Politeness = Politeness()) -> DataFrame:
    """(host, interval, average, crawls, errors, streak, dead): a host's rate control after its outcomes (at, seq,
    status, retry_after, latency, delay), in milliseconds; the delay is the same for all outcomes of a host."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    events = outcomes.select(host, number("at"), "seq", number("status"), number("retry_after"), number("latency"), number("delay"))
    start = lambda: {"interval": 0, "average": 0, "crawls": 0, "errors": 0, "streak": 0, "dead": False}
    return fold_in_order(events, [host], ["at", "seq"], start, lambda a, e: apply_rate(a, e, p), "interval bigint, average bigint, crawls bigint, errors bigint, streak bigint, dead boolean")


def change_history(captures: DataFrame, page: list[str], order: list[str], digest: str) -> DataFrame:
    """Adds ``changed``: whether the digest differs from the page's capture before; null on the first one."""
    before = F.lag(digest).over(Window.partitionBy(*page).orderBy(*order))
    return captures.withColumn("changed", F.when(before.isNotNull(), (before != F.col(digest)).cast("int")))


def change_stats(captures: DataFrame, page: list[str], hour: str, order: list[str], digest: str) -> DataFrame:
    """Per page: captures, changes, trailing unchanged captures, first and last hour."""
    history = change_history(captures, page, order, digest)
    run = F.sum(F.coalesce("changed", F.lit(0))).over(Window.partitionBy(*page).orderBy(*order))
    last = history.withColumn("__run", run)
    per_run = last.groupBy(*page, "__run").agg(F.count("*").alias("n"), F.sum(F.coalesce("changed", F.lit(0))).alias("c"), F.min(hour).alias("a"), F.max(hour).alias("b"))
    top = F.max_by("n", "__run") - 1
    return per_run.groupBy(*page).agg(F.sum("n").alias("crawls"), F.sum("c").alias("changes"), top.alias("streak"), F.min("a").alias("first_seen"), F.max("b").alias("last_crawled"))


def reset_in_flight(urls: DataFrame) -> DataFrame:
    """Recovery: pages that were in flight are scheduled again; ``recovered`` marks them for counting."""
    was = F.col("status") == IN_FLIGHT
    return urls.withColumn("recovered", was).withColumn("status", F.when(was, SCHEDULED).otherwise(F.col("status")))


def redirects(outcomes: DataFrame, urls: DataFrame, canonical: Column) -> DataFrame:
    """Discoveries of redirect targets: same depth as the source, its priority as their weight.

    ``canonical`` is built over ``redirect_target`` and the source's ``url``."""
    moved = outcomes.where("redirect_target is not null and redirect_target <> ''").join(urls.select("url_id", "url", "depth", "priority", "host"), "url_id")
    return moved.withColumn("target", canonical).where("target is not null").select("url_id", "target", "depth", F.lit(3).alias("discovery_source"), F.col("host").alias("src_host"), F.col("priority").alias("link_weight"), F.col("at").alias("observed_at"))


def warm(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """Validators that a seed brings are taken over by pages that were never crawled."""
    prior = seeds.select("url_id", F.col("etag").alias("__e"), F.col("last_modified").alias("__m"))
    fresh = F.col("crawl_count") == 0
    joined = urls.join(prior, "url_id", "left")
    return joined.withColumn("etag", F.when(fresh, F.coalesce("__e", "etag")).otherwise(F.col("etag"))).withColumn("last_modified", F.when(fresh, F.coalesce("__m", "last_modified")).otherwise(F.col("last_modified"))).drop("__e", "__m")


def fetch_outcomes(results: DataFrame) -> DataFrame:
    """Fetch results (status, unchanged, digest, prior_digest, final_url, body_fp) as outcomes: an unchanged
    body or an equal digest is not modified, 3xx is a redirect to ``final_url``, 2xx carries its signals."""
    same = F.coalesce(F.col("unchanged"), F.lit(False)) | (F.col("status") == 304) | F.coalesce((F.col("digest") == F.col("prior_digest")) & F.col("status").between(200, 299), F.lit(False))
    moved = F.col("status").between(300, 399) & (F.col("status") != 304)
    good = F.col("status").between(200, 299) & ~same
    return results.withColumn("not_modified", same).withColumn("redirect_target", F.when(moved, F.col("final_url"))).withColumn("content_fp", F.when(good, F.col("body_fp"))).withColumn("retryable", (F.col("status") == 0) | (F.col("status") == 429) | F.col("status").between(500, 599))


def http_hours(value: Column) -> Column:
    """Hours of an HTTP date in any of its three forms; null for anything else or before 1970."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(value), "^[A-Za-z]+,? +", ""), " +", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, "-([7-9][0-9]) ", "-19$1 "), "-([0-6][0-9]) ", "-20$1 ")
    forms = ("dd MMM yyyy HH:mm:ss 'GMT'", "dd-MMM-yyyy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy")
    seconds = F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(clean, F.lit(f))) for f in forms])
    return F.when(seconds >= 0, F.floor(seconds / 3600))
