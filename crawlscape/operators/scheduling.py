"""Order of dispatch: what is due, in which host's turn, at which second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.importance import front_bucket
from ..functions.politeness import step_seconds
from ..schema import EXCLUDED, GONE, IN_FLIGHT, SCHEDULED, TRAPPED, Scheduler
from ..storage import cutter


def due_urls(urls: DataFrame, before: Column, order: list[Column], host: Column | None = None, limit: int = 0) -> DataFrame:
    """Live due list: 0 is due now; pages in flight, gone, excluded or trapped are not. A limit becomes a top-k."""
    due = urls.where(~F.col("status").isin(IN_FLIGHT, GONE, EXCLUDED, TRAPPED) & (F.col("next_due") <= before))
    due = due if host is None else due.where(host)
    return due.orderBy("next_due", *order).limit(limit) if limit else due


def due_cold(urls: DataFrame, now: Column) -> DataFrame:
    """Cold due list: 0 is unscheduled, the status is not read."""
    return urls.where((F.col("next_due") != 0) & (F.col("next_due") <= now))


def dispatch_times(urls: DataFrame, host: str, delay: str, priority: str, seq: str, start: int = 0) -> DataFrame:
    """Adds ``rn``, ``at`` and ``bucket``: the k-th URL of a host, best priority first and then by ``seq``,
    leaves k-1 steps after ``start``.

    Exact for hosts with constant delays that share no address. Windows are per host; a host's queue is as
    long as its URL budget allows, which bounds the group."""
    ranked = urls.withColumn("bucket", front_bucket(F.col(priority)))
    turn = Window.partitionBy(host).orderBy(F.col("bucket").desc(), seq)
    step = step_seconds(F.col(delay).cast("long") * 100)
    return ranked.withColumn("rn", F.row_number().over(turn)).withColumn("at", (F.lit(start) + (F.col("rn") - 1) * step).cast("long"))


def in_dispatch_order(timed: DataFrame, host_order: list[Column]) -> DataFrame:
    """Sorted over ranges of (second, bucket, host); no single task sees all rows."""
    return timed.orderBy("at", F.col("bucket").desc(), *host_order)


def spread(urls: DataFrame, host: str, order: list[Column], step: Column, start: int = 0) -> DataFrame:
    """Adds ``at`` where every URL has a step of its own: a running sum of the steps before it."""
    before = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return urls.withColumn("at", F.lit(start) + F.coalesce(F.sum(step).over(before), F.lit(0)))


def eligible(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Adds ``eligible``: the later of the host's and its address' next second; no address never gates."""
    joined = hosts.join(addresses.select("ip", F.col("next_eligible").alias("__ip")), "ip", "left")
    return joined.withColumn("eligible", F.greatest("host_next_eligible", F.coalesce("__ip", F.lit(0)))).drop("__ip")


def evict_addresses(addresses: DataFrame, now: Column, idle: int) -> DataFrame:
    return addresses.where(F.col("next_eligible") + idle > now)


def shared_address_dispatch(urls: DataFrame, start: int = 0, ip_step: int = 1, rows_per_range: int = 5000) -> DataFrame:
    """(ip, host, url, at): hosts that share an address take turns.

    ``urls`` has (ip, host, url, delay_s, bucket, seq). A host without an address is a group of its own. An
    address is free again no sooner than the host it last served, so that all its hosts are ready at every turn
    and the best head leaves: the order is (bucket, host, seq) and ``at`` the running sum of the steps before.
    Ranges of that order are summed on their own and start at the sums of the ranges before, so that an
    address may have any number of rows."""
    step = F.greatest(F.lit(1), F.col("delay_s").cast("long"))
    own = F.when(F.col("ip").isNull(), F.col("host"))
    steps = urls.select("ip", "host", "url", "bucket", "seq", own.alias("__own"), F.when(F.col("ip").isNull(), step).otherwise(F.greatest(step, F.lit(ip_step))).alias("__step"))
    order = [F.col("bucket").desc(), F.col("host"), F.col("seq"), F.col("url")]
    ranges = max(1, -(-urls.count() // rows_per_range))
    keep = cutter(urls.sparkSession, "shared-address")
    # written, since ranges drawn a second time could have other bounds
    dealt = keep(steps.repartitionByRange(ranges, "ip", "__own", *order).withColumn("__range", F.spark_partition_id()), "ranges")
    group = [F.coalesce("ip", F.lit("")).alias("__ip"), F.col("ip").isNull().alias("__alone"), "__own"]
    sums = dealt.groupBy(*group, "__range").agg(F.sum("__step").alias("__sum"))
    earlier = Window.partitionBy("__ip", "__alone", "__own").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__ip", "__alone", F.col("__own").alias("__host"), F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range", "ip", "__own").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__inside", F.coalesce(F.sum("__step").over(inside), F.lit(0)))
    same = (F.col("__range") == F.col("__r")) & (F.coalesce("ip", F.lit("")) == F.col("__ip")) & (F.col("ip").isNull() == F.col("__alone")) & F.col("__own").eqNullSafe(F.col("__host"))
    return summed.join(offsets, same).select("ip", "host", "url", (F.lit(start) + F.col("__before") + F.col("__inside")).cast("long").alias("at"))


def promote_aged(urls: DataFrame, now: Column, s: Scheduler = Scheduler()) -> DataFrame:
    """A scheduled URL that has waited ``age_hours`` gets priority 1."""
    aged = (now - F.col("enqueued") >= s.age_hours) & (F.col("status") == SCHEDULED)
    return urls.withColumn("priority", F.when(aged, F.lit(1.0)).otherwise(F.col("priority").cast("double")))


def active_hosts(urls: DataFrame, host: str, threads: int, s: Scheduler = Scheduler()) -> DataFrame:
    """Hosts that are bound first, by their best bucket and earliest URL, up to three queues for each thread: a top-k."""
    best = urls.groupBy(host).agg(F.max("bucket").alias("bucket"), F.min("seq").alias("seq"))
    return best.orderBy(F.col("bucket").desc(), "seq").limit(max(1, threads * s.queues_per_thread)).select(host)


def split_streams(discovery: DataFrame, refresh: DataFrame, seq: str, shares: tuple[float, float] = (0.8, 0.2)) -> DataFrame:
    """Both streams interleaved at their shares: each row's turn is its number over the stream's share, ties
    to discovery. Numbers come from ranges of ``seq``, not from one sorted task."""
    turns = []
    for rank, (stream, share) in enumerate(zip((discovery, refresh), shares, strict=True)):
        turns.append(numbered(stream, [seq]).withColumn("turn", F.col("number") / F.lit(share)).withColumn("stream", F.lit("discovery" if rank == 0 else "refresh")))
    return turns[0].unionByName(turns[1])


def numbered(df: DataFrame, order: list[str], name: str = "number", ranges: int = 0, rows_per_range: int = 500_000) -> DataFrame:
    """Numbers rows from 0 in ``order``, nulls first: ranges of the whole order, as many as keep each at about
    ``rows_per_range`` rows, are numbered on their own and start at the counts of the ranges before.

    Rows that tie in the whole order share a range and are numbered in any order. The one window without a key
    has a row for each range."""
    ranges = ranges or max(1, -(-df.count() // rows_per_range))
    keep = cutter(df.sparkSession, "numbered")
    # written, since ranges drawn a second time could have other bounds
    dealt = keep(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__range", "__inside", "__start")


def shard_of(host_key: Column, shards: int) -> Column:
    from ..functions.keys import unsigned_mod

    return unsigned_mod(host_key, shards).cast("int")
