import weakref
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from crawlscape.llm import bpe, common, jaccard


def test_numbers_of_equal_and_null_keys_repeat(spark):
    """A key of half the rows, nulls and ties are numbered without gaps, and alike however the rows are dealt."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"), (F.col("id") % 5).cast("string").alias("g"), F.col("id").alias("other"))
    one = common.number_rows(rows.repartition(3), ["g"], ["k"], 4000, 50).collect()
    two = common.number_rows(rows.repartition(7, "other"), ["g"], ["k"], 4000, 50).collect()
    assert {r.other: r.slot for r in one} == {r.other: r.slot for r in two}
    for g, n in Counter(r.g for r in one).items():
        assert sorted(r.slot for r in one if r.g == g) == list(range(n))


def test_lookup_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") == 3, None).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    plain = rows.join(table, "k", "left")
    dealt = common.lookup(rows, table, ["k"], ["v"], 1000)
    assert sorted((r.v, str(r.k), str(r.x)) for r in dealt.collect()) == sorted((r.v, str(r.k), str(r.x)) for r in plain.collect())
    assert common.lookup(rows, table, ["k"], ["v"], 1000, "inner").count() == rows.join(table, "k").count()
    assert common.hot_keys(rows, ["k"], 1000).count() == 20 + 1 - 1


def test_a_worker_holds_one_operators_tables():
    """A worker that served the tokenizer and goes on to shingles, or to a task that holds nothing, lets the former go."""
    coder = weakref.ref(bpe._load(bpe.word_bpe_path()))
    assert bpe._load(bpe.word_bpe_path()) is coder()
    shingles = weakref.ref(jaccard._shingler(5))
    assert coder() is None and jaccard._shingler(5) is shingles()
    common.let_go()
    assert shingles() is None


def test_small_table_is_local(spark):
    schema = pa.schema([("s", pa.string()), ("n", pa.int64())])
    df = common.small_table(spark, [("a", 1), (None, 2), ("", 1 << 40)], schema)
    assert [tuple(r) for r in df.collect()] == [("a", 1), (None, 2), ("", 1 << 40)]
    assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    none = common.small_table(spark, [], schema)
    assert none.count() == 0 and none.dtypes == df.dtypes == [("s", "string"), ("n", "bigint")]
