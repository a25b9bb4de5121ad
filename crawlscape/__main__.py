"""Command line: each command is a DataFrame job over capture listings or written partitions.

    python -m crawlscape seed     --input captures.jsonl --data DIR
    python -m crawlscape run      --input captures.jsonl --data DIR [--delay 10] [--files 4] [--fetcher module:function --until HOURS]
    python -m crawlscape schedule --data DIR --now HOURS [--limit 50] [--host HOST]
    python -m crawlscape stats | inspect | map | bench  --data DIR
    python -m crawlscape compact  --data DIR [--merge DIR ...] [--out DIR]
"""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, urls
from .operators import costs, dedup, placement, scheduling
from .schema import CRAWLED, SCHEDULED, STATUS, Scheduler
from .sources import captures, layout
from .streaming.engine import Crawl


def seeded(spark: SparkSession, path: str, priority: float) -> tuple[DataFrame, int, int]:
    """(pages in their first state, lines read, lines skipped)."""
    rows = captures.read_captures(spark, path)
    read, skipped = rows.agg(F.count("*"), F.count_if("skipped")).head()
    found = captures.seed_discoveries(rows, priority)
    pages = found.withColumn("host", urls.group_of(F.col("url"))).select(keys.host_key(F.col("host")).alias("host_key"), keys.path_key(F.col("url")).alias("path_key"), F.lit(SCHEDULED).cast("tinyint").alias("status"), F.col("link_weight").alias("priority"), F.col("depth"), F.col("discovery_source").cast("tinyint").alias("discovery_source"), "url", "host", F.coalesce("observed_at", F.lit(0)).cast("int").alias("first_seen"), F.lit(0).alias("next_due"), F.lit(0).cast("long").alias("crawl_count"))
    return pages, read, skipped


def drained(pages: DataFrame, delay: int, start: int = 0) -> DataFrame:
    """Every page dispatched once, in its host's turn, and crawled without a fault."""
    timed = scheduling.dispatch_times(pages.withColumn("delay", F.lit(delay)), "host", "delay", "priority", "url", start)
    hour = F.floor(F.col("at") / 3600).cast("int")
    return timed.withColumn("status", F.lit(CRAWLED).cast("tinyint")).withColumn("crawl_count", F.lit(1).cast("long")).withColumn("last_crawled", hour).withColumn("next_due", hour + Scheduler().recrawl_gap)


def crawled(spark: SparkSession, pages: DataFrame, root: str, fetcher: str, delay: int, until: int) -> DataFrame:
    """Seeds run through the streaming crawl with the named fetcher, and through the turns that fall due up to ``until``.

    A second call with the same folder goes on from what the first one left."""
    module, _, function = fetcher.partition(":")
    seeds = pages.select("url", "host", F.col("host").alias("src_host"), F.col("depth").cast("int").alias("depth"), F.col("path_key").alias("seq"), F.col("priority").cast("double").alias("link_weight"))
    seeds.write.mode("ignore").parquet(f"{root}/seeds")
    crawl = Crawl(spark, root, getattr(importlib.import_module(module), function), delay)
    crawl.start(spark.readStream.schema(seeds.schema).parquet(f"{root}/seeds")).awaitTermination()
    crawl.drain(until)
    state = crawl.pages().select("url", F.col("status").cast("tinyint").alias("status"), F.col("priority").cast("float").alias("priority"), "crawl_count", F.col("last_crawled").cast("int").alias("last_crawled"), F.col("next_due").cast("int").alias("next_due"))
    return pages.drop("status", "priority", "crawl_count", "next_due").join(state, "url")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("crawlscape", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["seed", "run", "serve", "pack", "schedule", "stats", "inspect", "map", "compact", "bench"])
    parser.add_argument("--input")
    parser.add_argument("--data", required=True)
    parser.add_argument("--out")
    parser.add_argument("--merge", nargs="*", default=[], help="further partitions to compact with, of other key ranges")
    parser.add_argument("--priority", type=float, default=0.5)
    parser.add_argument("--delay", type=int, default=10, help="deciseconds")
    parser.add_argument("--now", type=int, default=0, help="hours")
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--host")
    parser.add_argument("--fetcher", help="module:function that gets a page as a dict and returns its outcome; without one, every page is taken as crawled")
    parser.add_argument("--until", type=int, default=0, help="hours of retries and recrawls after the seeds")
    parser.add_argument("--files", type=int, default=4)
    parser.add_argument("--parts", type=int, default=16)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("crawlscape").getOrCreate()
    show = lambda title, rows: print(costs.report(title, [(str(k), str(v)) for k, v in rows]))

    if args.command in ("seed", "run", "serve", "pack"):
        pages, read, skipped = seeded(spark, args.input, args.priority)
        if args.command == "seed":
            done = pages
        elif args.fetcher:
            done = crawled(spark, pages, f"{args.data}-crawl", args.fetcher, args.delay, args.until)
        else:
            done = drained(pages, args.delay)
        layout.write_partition(done, args.data, args.files)
        if args.command == "pack":
            layout.write_wheel(done, f"{args.data}-wheel")
        show(args.command, [("captures", read), ("skipped", skipped), ("urls", spark.read.parquet(args.data).count())])
        return 0

    pages = spark.read.parquet(args.data)
    if args.command == "schedule":
        due = layout.due_parts(pages.withColumnRenamed("next_due", "due_min"), F.lit(args.now)).withColumnRenamed("due_min", "next_due") if args.now else pages
        due = due.where(F.col("host") == args.host) if args.host else due
        top = due.orderBy(keys.unsigned(F.col("host_key")), keys.unsigned(F.col("path_key")))
        for row in (top.limit(args.limit) if args.limit else top).select("host_key", "path_key", "next_due", "url").toLocalIterator():
            print(f"{row.host_key & (2**64 - 1):016x}:{row.path_key & (2**64 - 1):016x}  due {row.next_due}  {row.url}")
    elif args.command == "stats":
        for row in pages.groupBy("status").agg(F.count("*").alias("n"), F.min("next_due").alias("due")).orderBy("status").collect():
            print(f"{STATUS.get(row.status, f'status({row.status})'):<12} {row.n:>10}  earliest due {row.due}")
    elif args.command == "inspect":
        chunks = layout.inspect(spark, args.data).cache()
        total, n = chunks.agg(F.sum("bytes")).head()[0], pages.count()
        show("columns", [(r.column, f"{r.bytes} bytes, {r.bytes_per_url:.2f} a URL") for r in costs.region_costs(chunks, n).orderBy("column").collect()])
        show("encodings", [(r.encoding, r["count"]) for r in layout.encoding_counts(chunks).orderBy("encoding").collect()])
        show("file", [("urls", n), ("bytes", costs.human_bytes(total)), ("bytes/url", f"{total / max(1, n):.2f}")])
    elif args.command == "map":
        flipped = pages.withColumn("partition_id", F.spark_partition_id()).withColumn("host_key", keys.unsigned(F.col("host_key")))
        files = layout.manifest(flipped)
        for row in files.orderBy("lo").collect():
            print(f"part {row.partition_id}: {row.lo + 2**63:016x}..{row.hi + 2**63:016x}  {row.url_count} urls, {row.host_count} hosts")
        for row in placement.coverage_breaks(files, -(1 << 63), (1 << 63) - 2).collect():
            print(f"{row.kind} at {row.at_lo + 2**63:016x}..{row.at_hi + 2**63:016x}")
    elif args.command == "compact":
        merged = functools.reduce(layout.merge, [pages, *(spark.read.parquet(d) for d in args.merge)])
        layout.write_partition(layout.compact(merged), args.out or f"{args.data}-compacted", args.files)
    else:
        chunks, n = layout.inspect(spark, args.data), pages.count()
        size = chunks.agg(F.sum("bytes")).head()[0] / max(1, n)
        measured = dedup.filter_figures(pages.select(F.xxhash64("host_key", "path_key").alias("k")), "k").head()
        show("seen filter", [("bits/url", f"{measured.bits_per_url:.2f}"), ("false negatives", measured.false_negatives), ("false-positive rate", f"{measured.false_positive_rate:.4f}")])
        row = spark.range(1).select(*costs.projection(F.lit(measured.bits_per_url), F.lit(size), 1e11, 3e7)).head()
        show("projection to 1e11 URLs", [("bytes/url", f"{size:.2f}"), ("partitions", f"{row.partitions:.0f}"), ("files", costs.human_bytes(row.file_bytes)), ("seen filters", costs.human_bytes(row.seen_bytes))])
        hosts = pages.groupBy("host_key").agg(F.count("*").alias("urls"), (F.count("*") * size).cast("long").alias("bytes")).withColumn("crawl_delay", F.lit(args.delay))
        moved = costs.rebalance_cost(hosts, keys.owner(F.col("host_key"), args.parts)).head()
        show(f"rebalance to {args.parts}", [("moved hosts", moved.moved_hosts), ("shipped", costs.human_bytes(moved.shipped_bytes)), ("fraction", f"{moved.moved_fraction:.3f}")])
        polite = costs.polite_ceiling(hosts).head()
        show("politeness", [("hosts", polite.hosts), ("summed rate", f"{polite.summed:.1f}/s")])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
