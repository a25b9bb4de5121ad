"""Seen-set: first sightings, batch classification, and compact membership filters."""

from __future__ import annotations

import math
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cutter

STEP = 1 << 16  # keys that are taken apart or probed at a time


def first_sightings(batch: DataFrame, seen: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The earliest row of every key that ``seen`` does not hold. Sized by the optimizer: no side is forced."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), seq).alias("__r"))
    return first.join(seen.select(*keys).distinct(), keys, "left_anti").select(*keys, "__r.*")


def rediscoveries(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return batch.join(seen.select(*keys), keys, "left_semi")


def classify_batch(batch: DataFrame, seen: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Adds ``unique``: the first row of its key in the batch, of a key that was not seen before.

    First rows come from an aggregate with map-side combine, so that a key that fills
    half of the batch is not sorted in one task."""
    first = batch.groupBy(*keys).agg(F.min(seq).alias("__first"))
    known = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return batch.join(first, keys).join(known, keys, "left").withColumn("unique", F.col("__seen").isNull() & (F.col(seq) == F.col("__first"))).drop("__first", "__seen")


def seen_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class BlockedBloom:
    """Bits of a key lie in one block of 512; sized for a false-positive rate with some headroom."""

    KIND, HEADROOM = 0, 1.15

    def __init__(self, capacity: int, rate: float = 0.01):
        bits = -math.log(rate) / math.log(2) ** 2 * self.HEADROOM
        self.probes = min(16, max(1, round(bits * math.log(2))))
        self.count, self.words = 0, np.zeros((max(1, math.ceil(capacity * bits / 512)), 8), np.uint64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = _mixed(keys, 1), _mixed(keys, 2) | np.uint64(1)
        inside = (b[:, None] * np.arange(1, self.probes + 1, dtype=np.uint64)) >> np.uint64(55)
        return (a % np.uint64(len(self.words))).astype(np.int64), inside.astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        block, inside = self._places(keys)
        np.bitwise_or.at(self.words, (np.repeat(block, self.probes), inside.ravel() >> 6), np.uint64(1) << (inside.ravel() & 63).astype(np.uint64))
        self.count += len(keys)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        block, inside = self._places(keys)
        return ((self.words[block[:, None], inside >> 6] >> (inside & 63).astype(np.uint64)) & np.uint64(1)).all(1)

    def bits_per_key(self) -> float:
        return self.words.size * 64 / max(1, self.count)

    def dump(self) -> bytes:
        return struct.pack("<BBQQ", self.KIND, self.probes, self.count, len(self.words)) + self.words.tobytes()


class Ribbon:
    """A static filter: each key is a band of 64 bits over GF(2) whose solution rows add up to its r-bit mark."""

    KIND, BAND, LOAD = 1, 64, 0.90

    def __init__(self, keys: np.ndarray, rbits: int = 7):
        keys = np.unique(keys)
        self.rbits, self.count = rbits, len(keys)
        self.rows = np.zeros(0, np.uint8)
        slots = math.ceil(len(keys) / self.LOAD) + self.BAND
        for self.seed in range(256):
            self.slots = slots if self.seed % 64 else (slots if self.seed == 0 else math.ceil(slots * 1.05 ** (self.seed // 64)))
            if self._solve(keys):
                return
        raise ValueError("no seed solves the band")

    def _derive(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = (_mixed(keys, 3 * self.seed + 5) % np.uint64(self.slots - self.BAND + 1)).astype(np.int64)
        mark = (_mixed(keys, 3 * self.seed + 7) & np.uint64((1 << self.rbits) - 1)).astype(np.int64)
        return start, _mixed(keys, 3 * self.seed + 6) | np.uint64(1), mark

    def _solve(self, keys: np.ndarray) -> bool:
        # slots lie in flat arrays and keys are taken apart STEP at a time: as lists of numbers they took ten times the memory
        rows, marks = array("Q", bytes(8 * self.slots)), bytearray(self.slots)
        order = np.argsort(self._derive(keys)[0], kind="stable")
        for at in range(0, len(order), STEP):
            for s, b, m in zip(*(part.tolist() for part in self._derive(keys[order[at : at + STEP]])), strict=True):
                while rows[s]:
                    b, m = b ^ rows[s], m ^ marks[s]
                    if not b:
                        break
                    skip = (b & -b).bit_length() - 1
                    b, s = b >> skip, s + skip
                if b:
                    rows[s], marks[s] = b, m
                elif m:
                    return False
        solution = bytearray(self.slots + self.BAND)
        for s in range(self.slots - 1, -1, -1):
            b, m, at = rows[s] >> 1, marks[s], s + 1
            while b:
                skip = (b & -b).bit_length() - 1
                m ^= solution[at + skip]
                b, at = b >> (skip + 1), at + skip + 1
            solution[s] = m if rows[s] else 0
        self.rows = np.frombuffer(solution, np.uint8)
        return True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        start, band, mark = self._derive(keys)
        found = np.zeros(len(keys), np.int64)
        for i in range(self.BAND):
            found ^= np.where((band >> np.uint64(i)) & np.uint64(1) == 1, self.rows[start + i], 0)
        return found == mark

    def bits_per_key(self) -> float:
        return self.slots * self.rbits / max(1, self.count)

    def dump(self) -> bytes:
        bits = np.unpackbits(self.rows[:, None], axis=1, bitorder="little")[:, : self.rbits]
        return struct.pack("<BBQQH", self.KIND, self.rbits, self.count, self.slots, self.seed) + np.packbits(bits.ravel(), bitorder="little").tobytes()


def load_filter(blob: bytes) -> BlockedBloom | Ribbon:
    if blob[0] == BlockedBloom.KIND:
        _, probes, count, blocks = struct.unpack_from("<BBQQ", blob)
        out = BlockedBloom.__new__(BlockedBloom)
        out.probes, out.count = probes, count
        out.words = np.frombuffer(blob, np.uint64, blocks * 8, struct.calcsize("<BBQQ")).reshape(-1, 8).copy()
        return out
    if blob[0] != Ribbon.KIND:
        raise ValueError("unknown filter kind")
    _, rbits, count, slots, seed = struct.unpack_from("<BBQQH", blob)
    out = Ribbon.__new__(Ribbon)
    out.rbits, out.count, out.slots, out.seed = rbits, count, slots, seed
    size = slots + Ribbon.BAND
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, struct.calcsize("<BBQQH")), bitorder="little")[: size * rbits].reshape(size, rbits)
    out.rows = np.packbits(np.pad(bits, ((0, 0), (0, 8 - rbits))), axis=1, bitorder="little")[:, 0]
    return out


def buckets_for(keys: DataFrame, per_bucket: int = 1_000_000) -> int:
    """Buckets of about ``per_bucket`` keys, which a task holds as one filter; 8 at least."""
    return max(8, -(-keys.count() // per_bucket))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def build_filters(keys: DataFrame, key: str, buckets: int, kind: str = "bloom", rate: float = 0.01, rbits: int = 7) -> DataFrame:
    """(bucket, keys, bits_per_key, blob): one filter per hash bucket of the distinct keys; ``buckets_for`` gives a
    number whose buckets fit a task. Null keys are in no filter."""

    def build(group: pa.Table) -> pa.Table:
        own = group["__k"].to_numpy().astype(np.int64).view(np.uint64)
        if kind == "ribbon":
            made = Ribbon(own, rbits)
        else:
            made = BlockedBloom(len(own), rate)
            for at in range(0, len(own), STEP):
                made.add(own[at : at + STEP])
        return pa.table({"bucket": group["bucket"][:1].cast(pa.int32()), "keys": [len(own)], "bits_per_key": [made.bits_per_key()], "blob": [made.dump()]})

    known = keys.select(F.col(key).cast("long").alias("__k")).where("__k is not null").distinct().withColumn("bucket", _bucket("__k", buckets))
    return known.groupBy("bucket").applyInArrow(build, "bucket int, keys long, bits_per_key double, blob binary")


def probe_filters(rows: DataFrame, key: str, filters: DataFrame, buckets: int, per_task: int = 500_000) -> DataFrame:
    """Adds ``maybe_seen``; false is certain, and a null key was never seen. Rows meet the filter of their bucket,
    dealt by all their columns over as many tasks as keep each at about ``per_task`` rows; equal rows share one, so
    that a table with very many of them is to be made distinct first, as ``unseen`` does."""
    salts = max(8, -(-rows.count() // (buckets * per_task)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    dealt = rows.withColumn("__k", F.coalesce(F.col(key).cast("long"), F.lit(0))).withColumn("__bucket", _bucket("__k", buckets)).withColumn("__salt", salt)
    spread = filters.select(F.col("bucket").alias("__bucket"), "blob").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left["__k"].to_numpy().astype(np.int64).view(np.uint64)
        hit = np.zeros(len(left), bool)
        if len(right) and len(left):
            known_keys = load_filter(right["blob"][0].as_py())
            for at in range(0, len(keys), STEP):
                hit[at : at + STEP] = known_keys.maybe(keys[at : at + STEP])
        known = left[key].is_valid().to_numpy()
        return left.drop_columns(["__k", "__bucket", "__salt"]).append_column("maybe_seen", pa.array(hit & known, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", maybe_seen boolean"
    return dealt.groupBy("__bucket", "__salt").cogroup(spread.groupBy("__bucket", "__salt")).applyInArrow(probe, schema)


def unseen(rows: DataFrame, seen: DataFrame, key: str, kind: str = "bloom") -> DataFrame:
    """Rows whose key ``seen`` does not hold: a filter's no is final, and only its maybes are joined with the
    keys. Each distinct key is probed once; rows of a null key were never seen."""
    keep = cutter(rows.sparkSession, "unseen")
    buckets = buckets_for(seen)
    probed = keep(probe_filters(rows.select(key).distinct(), key, build_filters(seen, key, buckets, kind), buckets), "probed")
    fresh = probed.where("maybe_seen").join(seen.select(key), key, "left_anti").unionByName(probed.where("not maybe_seen")).select(key)
    return rows.join(fresh, key, "left_semi").unionByName(rows.where(F.col(key).isNull()))


def filter_figures(keys: DataFrame, key: str, kind: str = "bloom") -> DataFrame:
    """One row (keys, bits_per_url, false_negatives, false_positive_rate): a filter of all distinct keys, probed with
    each of them and with as many that it doesn't hold. Without keys the rates are 0."""
    known = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    buckets = buckets_for(known)
    filters = cutter(keys.sparkSession, "figures")(build_filters(known, "k", buckets, kind), "filters")  # read twice
    other = known.select(F.xxhash64(F.lit("absent"), "k").alias("k")).distinct().join(known, "k", "left_anti")
    probed = probe_filters(known.withColumn("present", F.lit(True)).union(other.withColumn("present", F.lit(False))), "k", filters, buckets)
    size = filters.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("keys"), F.coalesce(F.sum(F.col("bits_per_key") * F.col("keys")) / F.sum("keys"), F.lit(0.0)).alias("bits_per_url"))
    rates = probed.agg(F.count_if(F.col("present") & ~F.col("maybe_seen")).alias("false_negatives"), (F.count_if(~F.col("present") & F.col("maybe_seen")) / F.greatest(F.count_if(~F.col("present")), F.lit(1))).alias("false_positive_rate"))
    return size.join(F.broadcast(rates))


def in_sequence(*partition: str, order: str):
    return Window.partitionBy(*partition).orderBy(order)
