"""Token counts of documents in flat token files, from their separators alone.

A flat file is a run of fixed-width token ids in which one id ends each document
and nothing tells where. Files are read in blocks; each block finds its separators
with one vectorised comparison. A prefix scan over the blocks' sizes and last
separators then places every separator in its file and tells how many tokens of
its first document lie in earlier blocks, so that documents may span any number
of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscape.sources.files import open_ranged

from .common import Scratch, bounded_batches, parquet

BLOCK_TOKENS = 1 << 18
END = 50256


def blocks_of_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, payload) of raw binary token files under ``path``, of any size: every block is read by its
    range of bytes, in the task that it is dealt to."""
    step = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    count = F.greatest(F.ceil(F.col("length") / step), F.lit(1))
    total = files.agg(F.sum(count)).head()[0] or 0
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_ranged(name) as file:
                    data = file.read_at(step, block * step)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "payload"])

    tasks = max(1, min(100_000, -(-int(total) // 64)))
    return blocks.repartition(tasks, "file", "block").mapInArrow(read, "file string, block long, payload binary")


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """Per document of each file: ``file``, ``ordinal``, ``n_tokens`` without the separator, ``closed``,
    ``block`` and ``in_block``, the place of its separator (for an open end, null).

    ``blocks`` has (file, block, payload); blocks are ordered by number and need not be
    contiguous in numbers. Tokens after the last separator of a file are a document that
    is not closed; a null or empty payload has no tokens.
    """
    kind = np.dtype(f"<u{width}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for value in batch.column(2):
                raw = value.as_buffer() if value.is_valid else None
                ids = np.frombuffer(raw, kind) if raw is not None and raw.size else np.empty(0, kind)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int32))
            flat = np.concatenate(ends) if ends else np.empty(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["file", "block", "size", "ends"])

    found = blocks.select("file", "block", "payload").mapInArrow(find, "file string, block long, size long, ends array<int>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    last_end = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    placed = placed.withColumn("__last", last_end).withColumn("previous", F.coalesce(F.max("__last").over(before), F.lit(-1)))
    whole = Window.partitionBy("file")
    placed = placed.withColumn("__total", F.sum("size").over(whole)).withColumn("__final", F.max("block").over(whole))
    each = F.transform("ends", lambda e, i: F.struct((F.col("first") + i).alias("ordinal"), (F.col("base") + e - F.when(i == 0, F.col("previous")).otherwise(F.col("base") + F.get("ends", i - 1)) - 1).alias("n_tokens"), F.lit(True).alias("closed"), F.col("block").alias("block"), i.cast("long").alias("in_block")))
    stop = F.coalesce(F.col("__last"), F.col("previous"))
    rest = F.when((F.col("block") == F.col("__final")) & (stop < F.col("__total") - 1), F.array(F.struct((F.col("first") + F.size("ends")).alias("ordinal"), (F.col("__total") - stop - 1).alias("n_tokens"), F.lit(False).alias("closed"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("in_block"))))
    listed = F.concat(each, F.coalesce(rest, F.array()))
    return placed.select("file", F.explode(listed).alias("d")).select("file", F.col("d.ordinal").alias("ordinal"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.closed").alias("closed"), F.col("d.block").alias("block"), F.col("d.in_block").alias("in_block"))


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text to ids with the ranks in ``path``; strings of special tokens are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_flat(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenizes documents to flat streams, one per input partition, cut into blocks of tokens
    wherever they fill up: (file, block, payload, doc_ids that end in the block)."""
    size = 2 * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(path)
        file, block, buffer, ids = f"stream-{TaskContext.get().partitionId():06d}", 0, bytearray(), []

        def row(data: bytes, done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([done], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(1).slice(k, 64).to_pylist()]
                keys = batch.column(0).slice(k, 64).to_pylist()
                for key, text in zip(keys, texts, strict=True):
                    buffer += np.array([*encode(text), END], "<u2").tobytes()
                    while len(buffer) > size:
                        yield row(bytes(buffer[:size]), ids)
                        del buffer[:size]
                        block, ids = block + 1, []
                    ids.append(key)
        if buffer:
            yield row(bytes(buffer), ids)

    bounded_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(run, "file string, block long, payload binary, doc_ids array<long>")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by scanning the separators of the flat token streams.

    A null or empty text has 0 tokens; a null id stays null; repeated rows are counted each.
    """
    scratch = Scratch(spark, "token-files")
    flat = scratch.keep(write_flat(parquet(spark, sf_dir, "documents"), byte_bpe_path()), "flat")
    counted = scan(flat)
    owners = flat.select("file", "block", F.posexplode("doc_ids").alias("in_block", "doc_id")).withColumn("in_block", F.col("in_block").cast("long"))
    return counted.join(owners, ["file", "block", "in_block"]).select("doc_id", "n_tokens", "file", "ordinal")
