"""Session folders, tables and numbering that several corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscape.storage import bounded_batches, shared_folder  # noqa: F401

HOT_SHARE, HOT_ROWS = 10_000, 200
MOST_BUCKETS = 1 << 20


_held: dict[tuple, Any] = {}


def held(make: Callable, *args: Hashable) -> Any:
    """``make(*args)``, kept between the tasks of a Python worker until it is asked for something else. Workers go from
    one operator to the next, and each would keep the tables of all that it has served."""
    key = (make, *args)
    if key not in _held:
        let_go()
        _held[key] = make(*args)
        give_back()  # what making it took besides
    return _held[key]


def let_go() -> None:
    """For tasks that need nothing held."""
    if _held:
        _held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Arrow and glibc keep it, so that a worker that waits would still hold the most
    that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives back memory when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a local relation: from a list, Spark would send them through Python workers of their own."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage, removed on demand."""

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        Scratch.made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        # once the table is written its shuffle files have no reader left
        tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(tidy, None)
        conf.set(tidy, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.unset(tidy) if before is None else conf.set(tidy, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.difference_update(names)

    def only(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*sorted(self.names.difference(names)))

    @classmethod
    def drop_since(cls, count: int) -> None:
        """Removes the tables of all but the first ``count`` that were made, once what read them is written."""
        while len(cls.made) > count:
            cls.made.pop().only()


def hot_keys(rows: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """(keys, __parts): the keys that hold more than a HOT_SHARE-th of ``total`` rows, and in how many parts to
    deal them. Whatever the table, there are fewer than HOT_SHARE such keys."""
    most = max(HOT_ROWS, -(-total // HOT_SHARE))
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Sequence[str], total: int, how: str = "left", counted: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``, with the rows of a frequent key dealt over parts by a hash of
    their ``by`` columns; every part gets a copy of the key's rows of ``table``.

    Frequent keys are counted in ``counted``, of ``total`` rows, by default in ``rows``, or given as ``hot``. The parts follow from
    values alone, so that a task that runs again deals its rows as before. Null keys meet nothing.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(counted if counted is not None else rows, keys, total) if hot is None else hot)  # fewer than HOT_SHARE rows
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"))).drop("__parts")
    copies = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps: what tells rows of one key apart, the same whenever a task runs."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind], F.lit(11))


def number_rows(df: DataFrame, group: list[str], order: list[str], total: int, rows_per_bucket: int = 500, name: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, however large a group is.

    Rows of a group are dealt to buckets of about ``rows_per_bucket`` rows (more beyond
    MOST_BUCKETS buckets) by a hash of ``order``, a bucket that holds very many rows (of
    one key, or of null) to parts by a hash of the whole row. Each is numbered on its
    own, and their counts give the offsets. The order within a group is (bucket, part,
    ``order``, hash of the row): fixed by the data, not by partitioning, also for rows
    whose ``order`` is equal or null; only rows equal in all columns may change places.
    """
    buckets = max(1, min(MOST_BUCKETS, -(-total // rows_per_bucket)))
    most = 4 * max(rows_per_bucket, -(-total // buckets), -(-total // HOT_SHARE))
    keys = [f"__g{i}" for i in range(len(group))]
    # without nulls, so that the window's partitioning also serves the join
    dealt = df.withColumn("__tie", row_hash(df)).withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null")) for k, g in zip(keys, group, strict=True)})
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)))
    hot = dealt.groupBy(*keys, "__b").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys, "__b", F.ceil(F.col("__n") / most).alias("__parts"))
    # each holds more than a HOT_SHARE-th of ``total``, so that their number is bounded
    dealt = dealt.join(F.broadcast(hot), [*keys, "__b"], "left").withColumn("__s", F.coalesce(F.pmod("__tie", F.col("__parts")), F.lit(0))).drop("__parts")
    counts = dealt.groupBy(*keys, "__b", "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__b", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b", "__s").orderBy(*order, "__tie")) - 1)
    return numbered.join(offsets, [*keys, "__b", "__s"]).withColumn(name, (F.col("__r") + F.col("__off")).cast("long")).drop("__b", "__s", "__r", "__off", "__tie", *keys)
