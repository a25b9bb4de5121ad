import json

from pyspark.sql import functions as F

from crawlscape.__main__ import main
from crawlscape.schema import GONE


def test_commands(spark, tmp_path, capsys):
    lines = [{"url": f"http://h{i % 7}.com/p{i}", "host": f"h{i % 7}.com", "timestamp": "20240102030405"} for i in range(200)] + [{"host": "x"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    data = str(tmp_path / "data")
    assert main(["run", "--input", str(tmp_path / "c.jsonl"), "--data", data]) == 0
    for command in (["schedule", "--now", "10000000", "--limit", "3"], ["stats"], ["inspect"], ["map"], ["compact"], ["bench"]):
        assert main([command[0], "--data", data, *command[1:]]) == 0
    said = capsys.readouterr().out
    assert "skipped   1" in said and "crawled" in said and said.count("  due 168  http") == 3 and "bytes/url" in said and "moved hosts" in said
    assert "false negatives      0" in said


def test_compact_merges_partitions(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") - 20).alias("host_key"), F.col("id").alias("path_key"), F.when(F.col("id") % 4 == 0, 7).otherwise(3).cast("tinyint").alias("status"), F.lit("u").alias("url"))
    parts = [str(tmp_path / name) for name in "abc"]
    for path, kept in zip(parts, ("host_key >= 10", "host_key between 0 and 9", "host_key < 0"), strict=True):
        rows.where(kept).write.parquet(path)
    out = str(tmp_path / "out")
    assert main(["compact", "--data", parts[0], "--merge", *parts[1:], "--out", out, "--files", "2"]) == 0
    assert spark.read.parquet(out).count() == rows.where(F.col("status") != GONE).count()


def test_run_with_a_fetcher(spark, tmp_path, capsys):
    lines = [{"url": f"http://h{i % 3}.com/p/{i}", "host": f"h{i % 3}.com", "timestamp": "20240102030405"} for i in range(30)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    data = str(tmp_path / "data")
    assert main(["run", "--input", str(tmp_path / "c.jsonl"), "--data", data, "--fetcher", "tests.test_engine:fetch", "--until", "100"]) == 0
    pages = {r.url: r for r in spark.read.parquet(data).collect()}
    assert len(pages) == 30 and pages["http://h2.com/p/29"].status == 6 and pages["http://h2.com/p/17"].crawl_count == 1
    assert main(["schedule", "--data", data, "--now", "10000000", "--limit", "3"]) == 0 and capsys.readouterr().out.count("  due 168  ") == 3
