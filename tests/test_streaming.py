import pytest
from pyspark.sql import functions as F

from crawlscape.operators import admission
from crawlscape.streaming import loop, processors


@pytest.fixture
def run(spark, tmp_path):
    loop.use_state_store(spark)

    def go(df, build, name):
        src = str(tmp_path / "src")
        df.coalesce(1).write.parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = build(stream).writeStream.format("memory").queryName(name).outputMode("update" if name == "pages" else "append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    return go


def test_intake_is_the_batch_admission(spark, run):
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("host"), (F.col("id") * 7 % 200).cast("string").alias("url"), (F.col("id") % 11).cast("string").alias("src_host"), (F.col("id") % 7).cast("int").alias("depth"), F.col("id").alias("seq"))
    batch = admission.admit(rows.withColumn("trapped", F.lit(False)), F.lit(5))
    wanted = {(r.host, r.url): (r.url_count, r.url_budget, r.status) for r in batch.collect()}
    got = run(rows, lambda s: processors.intake(s, 5), "admitted")
    assert {(r.host, r.url): (r.url_count, r.url_budget, r.status) for r in got.collect()} == wanted


def test_outcome_updates(spark, run):
    rows = spark.createDataFrame([("a", 503, i, i) for i in range(7)] + [("b", 200, 5, 50)], "url string, status int, at long, seq long")
    got = {r.url: (r.status, r.retry_count, r.crawl_count) for r in run(rows, processors.outcome_updates, "pages").collect()}
    assert got == {"a": (6, 5, 0), "b": (4, 0, 1)}


def test_outcome_stream_is_the_batch_fold(spark, run):
    """304, redirects, retries, the end, equal, near and changed bodies, in several deliveries of one page."""
    import random

    from crawlscape.operators import outcomes

    rng = random.Random(2)
    rows = []
    for seq in range(1500):
        status = rng.choice([200, 200, 200, 200, 304, 301, 503, 404, 410 if seq % 40 == 0 else 200])
        fp = rng.choice([0, 5, 5, 9, 11])
        rows.append((f"u{rng.randrange(60)}", status, seq // 3, seq, status == 304, False, status == 0 or rng.random() < 0.05, fp, fp * 1_000_003 if fp != 9 else 5 * 1_000_003 + 1))
    df = spark.createDataFrame(rows, "url string, status long, at long, seq long, not_modified boolean, redirect boolean, retryable boolean, fp long, sim long")
    wanted = {r.url: tuple(r)[1:] for r in outcomes.fold(df, ["url"]).collect()}
    got = {r.url: tuple(r)[1:] for r in run(df, processors.outcome_updates, "pages").collect()}
    assert got == wanted and {6, 4} <= {x[0] for x in wanted.values()}


def test_guard_keeps_what_is_newer(spark, run):
    rows = spark.createDataFrame([("h", 1, 1.0), ("h", 3, 3.0), ("h", 3, 9.0), ("g", 2, 2.0)], "key string, version long, value double")
    assert sorted((r.key, r.version) for r in run(rows, processors.newer_only, "kept").collect()) == [("g", 2), ("h", 1), ("h", 3)]


def test_loop_parts(spark, tmp_path):
    assert loop.LogicalClock(5).sleep_until(9) == 9
    got = loop.fetch_batch(spark.range(10), lambda r: {"id": r["id"], "status": 200}, "id long, status int", 2)
    assert got.where("status = 200").count() == 10
    level = loop.WaterLevel(1.0, 1.0)
    assert level.tick(spark.createDataFrame([(0.1,)], "interval double")) == 1.05
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    query = loop.drive(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sum(seen) == 5


def test_timers_fire_when_time_passes(spark, tmp_path):
    loop.use_state_store(spark)
    early = spark.createDataFrame([("a", 1_000_000_060_000, 1_000_000_000), ("b", 9_000_000_000_000, 1_000_000_000)], "url string, due_ms long, at long")
    late = spark.createDataFrame([("c", 9_000_000_000_000, 1_000_000_120)], "url string, due_ms long, at long")
    for k, df in enumerate((early, late, late)):
        df.select("url", "due_ms", F.timestamp_seconds("at").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "src" / f"k={k}"))
    source = spark.readStream.schema("url string, due_ms long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src" / "*"))
    query = processors.due_timers(source, "at").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.url, r.due_at) for r in spark.table("fired").collect()] == [("a", 1_000_000_060_000)]
