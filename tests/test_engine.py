"""The running crawl against the batch operators."""

import pytest
from pyspark.sql import functions as F

from crawlscape.operators import scheduling
from crawlscape.schema import CRAWLED, GONE, TRAPPED
from crawlscape.streaming.engine import Crawl


def fetch(page: dict) -> dict:
    n = int(page["url"].rsplit("/", 1)[1])
    if n % 10 == 9:
        return {"status": 410}
    return {"status": 503 if n % 10 == 7 and page["retry_count"] < 2 else 200, "fp": n + 1}


@pytest.fixture
def found(spark):
    def rows(low, high, weight=0.5):
        host = F.concat(F.lit("h"), (F.col("id") % 5).cast("string"), F.lit(".com"))
        url = F.concat(F.lit("http://"), host, F.lit("/"), F.col("id").cast("string"))
        return spark.range(low, high).select(url.alias("url"), host.alias("host"), F.lit("x.com").alias("src_host"), (F.col("id") % 4).cast("int").alias("depth"), F.col("id").alias("seq"), F.lit(weight).alias("link_weight"))

    return rows


def test_crawl(spark, tmp_path, found):
    source = str(tmp_path / "in")
    found(0, 120).coalesce(1).write.parquet(f"{source}/a")
    crawl = Crawl(spark, str(tmp_path / "crawl"), fetch, delay=30)
    stream = lambda: spark.readStream.schema(found(0, 1).schema).option("recursiveFileLookup", "true").parquet(source)
    crawl.start(stream(), depth_cap=2).awaitTermination(120)

    pages = {r.url: r for r in crawl.pages().collect()}
    assert len(pages) == 120 and sum(p.status == TRAPPED for p in pages.values()) == 30
    live = crawl.pages().where(f"status <> {TRAPPED}")
    timed = scheduling.dispatch_times(live.withColumn("delay", F.lit(30)), "host", "delay", "priority", "url")
    wanted = {(r.url, r["at"]) for r in timed.collect()}
    assert {(r.url, r.second) for r in crawl.dispatched().collect()} == wanted
    status = lambda n: next(p.status for u, p in pages.items() if u.endswith(f"/{n}"))
    assert status(9) == GONE and status(4) == CRAWLED and status(17) == 1

    # the same turn again, and the query again without new files, change nothing
    assert crawl.turn(spark.createDataFrame([], "host STRING, url STRING, seq BIGINT, url_count BIGINT, url_budget BIGINT, status INT, depth BIGINT, weight DOUBLE"), 1) == 0
    crawl = Crawl(spark, str(tmp_path / "crawl"), fetch, delay=30)
    crawl.start(stream(), depth_cap=2).awaitTermination(120)
    assert {r.url: r for r in crawl.pages().collect()} == pages

    # links to known pages bring credit and a new price; retries come when they are due
    found(100, 130, 2.0).coalesce(1).write.parquet(f"{source}/b")
    crawl.start(stream(), depth_cap=2).awaitTermination(120)
    after = {r.url: r for r in crawl.pages().collect()}
    again = next(u for u in pages if u.endswith("/104"))
    assert len(after) == 130 and after[again].cash == 2.5 and after[again].priority > pages[again].priority
    assert crawl.drain(100) > 0
    last = {r.url: r for r in crawl.pages().collect()}
    assert {p.status for p in last.values()} == {CRAWLED, GONE, TRAPPED}
    retried = next(p for u, p in last.items() if u.endswith("/17"))
    assert (retried.crawl_count, retried.error_count, retried.retry_count) == (1, 2, 0)


def test_a_turn_that_failed_is_taken_up(spark, tmp_path, found):
    """A fault after the fetches: the turn is repeated, nothing is fetched twice."""
    from crawlscape.streaming.processors import ADMITTED

    rows = found(0, 40).select("host", "url", "seq", F.lit(0).cast("long").alias("url_count"), F.lit(64).cast("long").alias("url_budget"), F.lit(1).alias("status"), F.col("depth").cast("long").alias("depth"), F.col("link_weight").alias("weight"))
    assert [f.split()[0] for f in ADMITTED.split(", ")] == rows.columns
    crawl = Crawl(spark, str(tmp_path / "crawl"), fetch)
    append, crawl.store.append = crawl.store.append, lambda df: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        crawl.turn(rows, 1)
    first = {(r.url, r.second) for r in crawl.dispatched().collect()}
    assert crawl.pages().count() == 0 and len(first) == 40

    again = Crawl(spark, str(tmp_path / "crawl"), lambda page: {}["fetched twice"])
    assert again.turn(rows, 1) == 40 and again.pages().count() == 40
    assert {(r.url, r.second) for r in again.dispatched().collect()} == first
