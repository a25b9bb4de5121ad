"""Keys: XXH64 with seed 0, unsigned order, jump and rendezvous hashing."""

from __future__ import annotations

import logging
from functools import lru_cache

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

SIGN = -(1 << 63)
# Fixed value: seed bytes that precede a path when it is hashed.
PATH_SEED = (0x9E3779B97F4A7C15).to_bytes(8, "little").hex()


@lru_cache(maxsize=1)
def _native_xxh64() -> bool:
    """Whether the engine's classes for a hash with another seed can be reached; asked once."""
    names = ("org.apache.spark.sql.classic.ExpressionUtils", "org.apache.spark.sql.catalyst.expressions.XxHash64")
    try:
        for name in names:
            SparkSession.active()._jvm.java.lang.Class.forName(name)
    except (Py4JError, AttributeError, TypeError) as missing:
        logging.getLogger(__name__).warning("hashing through Arrow, as %s can't be reached: %s", names, missing)
        return False
    return True


def xxh64(column: Column) -> Column:
    """XXH64 of the bytes with seed 0, as a signed 64-bit number. It uses the engine's own hash expression
    with another seed; where that internal class can't be reached, an Arrow UDF gives the same numbers."""
    if not _native_xxh64():
        return _xxh64_arrow(column.cast("binary"))
    jvm = SparkSession.active()._jvm
    tools = jvm.org.apache.spark.sql.classic.ExpressionUtils
    arguments = jvm.org.apache.spark.api.python.PythonUtils.toSeq([tools.expression(column._jc)])
    return Column(tools.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(arguments, 0)))


@F.pandas_udf(LongType())
def _xxh64_arrow(values: pd.Series) -> pd.Series:
    import xxhash

    return pd.Series([None if v is None else np.uint64(xxhash.xxh64_intdigest(bytes(v))).astype(np.int64) for v in values], dtype="Int64")


def host_key(group: Column) -> Column:
    return xxh64(group)


def path_key(path: Column) -> Column:
    return xxh64(F.concat(F.unhex(F.lit(PATH_SEED)), path.cast("binary")))


def unsigned(key: Column) -> Column:
    """A signed number that orders as the unsigned bit pattern of ``key`` does."""
    return key.bitwiseXOR(F.lit(SIGN))


def unsigned_mod(key: Column, n: int) -> Column:
    """``key`` read as unsigned, modulo n: the low half and the high half apart."""
    high, low = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))
    return ((high % n) * F.lit((1 << 32) % n) + low % n) % n


def _jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hashing of a whole array; finished keys leave the loop."""
    state = keys.astype(np.uint64)
    bucket, jump = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state)) if buckets > 1 else np.empty(0, int)
    while len(live):
        bucket[live] = jump[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        jump[live] = ((bucket[live] + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < buckets]
    return bucket


def jump_hash(key: Column, buckets: int) -> Column:
    """Owner in [0, buckets) of a 64-bit key."""

    @F.pandas_udf("int")
    def jump(values: pd.Series) -> pd.Series:
        return pd.Series(_jump(values.fillna(0).astype("int64").to_numpy(), buckets)).astype("int32")

    return F.when(key.isNotNull(), jump(key))


def owner(key: Column, buckets: int, pins: dict[int, int] | None = None) -> Column:
    """Pinned keys first, then jump hashing."""
    placed = jump_hash(key, buckets)
    for pinned, partition in sorted((pins or {}).items()):
        placed = F.when(key == pinned, F.lit(partition)).otherwise(placed)
    return placed


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that gives rendezvous weights of (partition, machine)."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(LongType())
def rendezvous_weight(partition: pd.Series, machine: pd.Series) -> pd.Series:
    """Bit pattern of the unsigned weight; order it through ``unsigned``."""
    return pd.Series(_combined(partition.to_numpy(np.int64), machine.to_numpy(np.int64)).view(np.int64))


@F.pandas_udf(DoubleType())
def weighted_rendezvous(partition: pd.Series, machine: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series(_combined(partition.to_numpy(np.int64), machine.to_numpy(np.int64)).astype(np.float64) * weight.to_numpy(float))


def parse_key(text: Column) -> Column:
    """0x-hex or decimal text as the bit pattern of an unsigned 64-bit number; null if it is neither."""
    hexed = F.regexp_extract(text, "^0[xX]([0-9A-Fa-f]{1,16})$", 1)
    number = F.when(hexed != "", F.conv(hexed, 16, -10)).when(text.rlike("^[0-9]{1,20}$"), F.conv(text, 10, -10))
    return number.cast("long")


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1).cast("long"))))


def bit_width(v: Column) -> Column:
    """Bits needed for an unsigned value."""
    return F.length(F.regexp_replace(F.bin(v), "^0+$", "")).cast("int")
