"""Content signals: normalised bodies, fingerprints, simhash and change classes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cutter
from .keys import xxh64

NEAR_BITS, BLOCKS = 3, 6
TOKEN = re.compile(rb"[a-z0-9]+")


def normalize_body(body: Column) -> Column:
    """Runs of the six ASCII blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(body, "[ \\t\\n\\r\\f\\x0B]+", " "))


def content_fp(body: Column) -> Column:
    return xxh64(body)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0))


def token_xx64(token: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token)


def simhash(df: DataFrame, key: str, text: str, bits: int = 64, token_hash: Callable[[bytes], int] = token_xx64, out: str = "simhash") -> DataFrame:
    """(key, out) for every row: bit b is 1 if more tokens have a one than a zero there in their hash; 0 without
    tokens or text. A row is folded where it is read, in Arrow batches; hashes of the tokens that a task has met
    are kept, up to a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            made = np.zeros(batch.num_rows, np.uint64)
            for i, value in enumerate(batch.column(1)):
                found = TOKEN.findall((value.as_py() or "").encode("utf-8").lower())
                for token in set(found).difference(known):
                    known[token] = token_hash(token)
                if found:
                    hashes = np.fromiter(map(known.__getitem__, found), "<u8", len(found))
                    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].sum(0, dtype=np.int64)
                    made[i] = np.packbits(np.pad(2 * ones > len(found), (0, 64 - bits)), bitorder="little").view("<u8")[0]
                if len(known) > 200_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["key", "simhash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, simhash long").toDF(key, out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def change_kind(old_fp: Column, new_fp: Column, old_sim: Column, new_sim: Column) -> Column:
    """none, cosmetic or real: equal fingerprints, or simhashes within three bits (two empty ones too)."""
    return F.when(old_fp == new_fp, "none").when(hamming(old_sim, new_sim) <= NEAR_BITS, "cosmetic").otherwise("real")


def near_pairs(df: DataFrame, key: str, sim: str, radius: int = NEAR_BITS, width: int = 64, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance) of all pairs within ``radius`` bits.

    Of ``blocks`` blocks of bits a near pair has ``blocks - radius`` in common, so that pairs meet on the
    values of that many blocks, for every choice of them. Six blocks give twenty keys of half the bits each:
    keys that stay selective on billions of pages, where one block of 16 bits would gather thousands of
    unrelated ones. Equal simhashes are one point: every further row is paired with the smallest key only.
    Simhash 0 is no signal."""
    from itertools import combinations

    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    # written, since it is read four times
    rows = cutter(df.sparkSession, "near-pairs")(df.where(F.col(sim) != 0).select(F.col(key).alias("k"), F.col(sim).alias("s")), "points")
    points = rows.groupBy("s").agg(F.min("k").alias("k"))
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))
    keyed = points.select("k", "s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("s").bitwiseAND(m).alias("v")) for i, m in enumerate(masks)])).alias("p")).select("k", "s", "p.i", "p.v")
    # sorted on both sides, never broadcast: the optimizer doesn't count that each point stands there once for every key
    x, y = keyed.alias("x"), keyed.hint("merge").alias("y")
    apart = F.col("x.s").bitwiseXOR(F.col("y.s"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(m) == 0, F.lit(i)) for i, m in enumerate(masks)])  # of the keys of a pair only this one gives it
    met = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.k") < F.col("y.k")) & (F.bit_count(apart) <= radius) & (F.col("x.i") == first))
    found = met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.bit_count(apart).alias("distance"))
    same = rows.join(points.select(F.col("s"), F.col("k").alias("a")).hint("merge"), "s").where("k <> a").select("a", F.col("k").alias("b"), F.lit(0).alias("distance"))
    return found.unionByName(same)
