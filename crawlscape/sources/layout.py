"""Partitions on disk: sorted Parquet with page checks, a due-time wheel, manifests and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import unsigned
from ..schema import GONE, HOST_STATE, MANIFEST, URL_STATE
from .files import open_ranged

# Tiers of the wheel as (buckets, hours in each); one bucket more takes the rest.
TIERS = ((168, 1), (90, 24), (24, 720))
OVERFLOW = sum(n for n, _ in TIERS)


def due_bucket(offset: Column) -> Column:
    """Bucket of an offset in hours from the wheel's base."""
    out, first, begin = F.lit(OVERFLOW), OVERFLOW, sum(n * w for n, w in TIERS)
    for n, w in reversed(TIERS):
        first, begin = first - n, begin - n * w
        out = F.when(offset < begin + n * w, F.lit(first) + F.floor((offset - begin) / w)).otherwise(out)
    return out.cast("int")


def bucket_start(bucket: Column) -> Column:
    """The least offset that a bucket holds."""
    out, first, begin = F.lit(sum(n * w for n, w in TIERS)), OVERFLOW, sum(n * w for n, w in TIERS)
    for n, w in reversed(TIERS):
        first, begin = first - n, begin - n * w
        out = F.when(bucket < first + n, F.lit(begin) + (bucket - first) * w).otherwise(out)
    return out.cast("long")


def wheel(urls: DataFrame, due: str = "next_due") -> DataFrame:
    """Scheduled rows (due not 0) with ``base``, the earliest due hour, and ``bucket``."""
    base = urls.agg(F.min(F.nullif(F.col(due), F.lit(0))).alias("base"))
    return urls.where(F.col(due) != 0).join(F.broadcast(base)).withColumn("bucket", due_bucket(F.col(due) - F.col("base")))


def due_by_wheel(wheeled: DataFrame, now: Column, due: str = "next_due") -> DataFrame:
    """Rows of buckets that have opened, confirmed on the due hour; on a layout partitioned by bucket the other
    buckets are not read."""
    return wheeled.where((bucket_start(F.col("bucket")) + F.col("base") <= now) & (F.col(due) <= now))


def write_partition(urls: DataFrame, path: str, files: int, key: str = "host_key", second: str = "path_key", page_rows: int = 20_000) -> None:
    """Ranges of unsigned keys, sorted by both halves, zstd, delta and dictionary encodings, checked pages."""
    order = unsigned(F.col(key))
    laid = urls.withColumn("__o", order).repartitionByRange(files, "__o").sortWithinPartitions("__o", unsigned(F.col(second))).drop("__o")
    laid.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.page.row.count.limit", page_rows).option("parquet.page.write-checksum.enabled", "true").parquet(path)


def write_wheel(urls: DataFrame, path: str) -> None:
    """The layout whose directories are the wheel's buckets."""
    wheel(urls).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(URL_STATE).parquet(path)


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOST_STATE).parquet(path)


def host_range(urls: DataFrame, low: int, high: int, key: str = "host_key") -> DataFrame:
    """Inclusive range of signed keys, which row groups and pages are pruned by; split a range of unsigned keys
    that passes the sign bit in two."""
    return urls.where(F.col(key).between(low, high))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, encodings, bytes, raw_bytes, rows) of every column chunk. Executors read footers only, by
    ranges at the ends of files."""
    import pandas as pd

    def run(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            for name in pdf["path"]:
                with open_ranged(name) as file:
                    meta = pq.ParquetFile(file).metadata
                chunks = [(name, meta.row_group(g).column(c)) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
                rows = [(name, c.path_in_schema, ",".join(sorted(c.encodings)), c.total_compressed_size, c.total_uncompressed_size, c.num_values) for name, c in chunks]
                yield pd.DataFrame(rows, columns=["file", "column", "encodings", "bytes", "raw_bytes", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInPandas(run, "file string, column string, encodings string, bytes long, raw_bytes long, rows long")


def encoding_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(F.split("encodings", ",")).alias("encoding")).groupBy("encoding").count()


def manifest(urls: DataFrame, partition: str = "partition_id", key: str = "host_key", due: str = "next_due", epoch: int = 1) -> DataFrame:
    """One row per partition: key range (signed), counts, earliest scheduled hour."""
    return urls.groupBy(partition).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("url_count"), F.count_distinct(key).alias("host_count"), F.min(F.nullif(F.col(due), F.lit(0))).alias("due_min")).withColumn("epoch", F.lit(epoch).cast("long"))


def manifest_schema() -> str:
    return MANIFEST


def due_parts(files: DataFrame, now: Column) -> DataFrame:
    return files.where((F.col("due_min") != 0) & (F.col("due_min") <= now))


def compact(urls: DataFrame) -> DataFrame:
    """Without the pages that are gone; their hosts stay."""
    return urls.where(F.col("status") != GONE)


def split(urls: DataFrame, at: int, key: str = "host_key") -> tuple[DataFrame, DataFrame]:
    below = F.col(key) < at
    return urls.where(below), urls.where(~below)


def merge(a: DataFrame, b: DataFrame, key: str = "host_key") -> DataFrame:
    """Union of two partitions; key ranges that overlap, as unsigned numbers, raise an error."""
    flipped = unsigned(F.col(key))
    (alo, ahi), (blo, bhi) = (df.agg(F.min(flipped), F.max(flipped)).head() for df in (a, b))
    if None not in (alo, blo) and not (ahi < blo or bhi < alo):
        raise ValueError("key ranges overlap")
    return a.unionByName(b)


def extract(urls: DataFrame, moving: DataFrame, key: str = "host_key") -> tuple[DataFrame, DataFrame]:
    """(rows of the moving hosts, the rest)."""
    hosts = moving.select(key).distinct()
    return urls.join(hosts, key, "left_semi"), urls.join(hosts, key, "left_anti")


def unsorted_rows(urls: DataFrame, ranges: str, key: str = "host_key", second: str = "path_key", row: str = "row") -> DataFrame:
    """Rows that stand before a smaller key within their file."""
    from pyspark.sql import Window

    turn = Window.partitionBy(ranges).orderBy(row)
    a, b = F.lead(unsigned(F.col(key))).over(turn), F.lead(unsigned(F.col(second))).over(turn)
    mine, own = unsigned(F.col(key)), unsigned(F.col(second))
    return urls.withColumn("__bad", (a < mine) | ((a == mine) & (b < own))).where("__bad").drop("__bad")


def pack(urls: DataFrame, hosts: DataFrame, partition_id: int, created_hours: int, meta: dict[str, str] | None = None) -> dict:
    """A partition value: both tables and its metadata."""
    return {"urls": urls, "hosts": hosts, "partition_id": partition_id, "created_hours": created_hours, "meta": dict(sorted((meta or {}).items()))}
