"""Interleaving sources to target weights as a Pfair schedule.

Source i with weight w_i = q_i / Q is a periodic task whose block j may run from
slot floor(j / w_i) on and has to be placed before slot ceil((j + 1) / w_i). One
block is placed per slot, the released block with the earliest deadline first,
so that a source is never a whole block off its share. The schedule repeats
after Q slots with every source back on target, so that one period is laid out
on the driver (Q is bounded by a parameter) and every further block follows by
arithmetic, without a sequential pass over the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_rows, parquet, small_table

PERIOD = 4096
BLOCK_ROWS = 16
MOST_SOURCES = 65_536
TEMPERATURE = 0.5
ADDED = ("block", "release", "deadline", "slot", "row_in_block")


def quantise(targets: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole shares of a period: largest remainders, at least one share for each source."""
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    if not names:
        return {}
    if any(targets[s] <= 0 for s in names):
        raise ValueError("target weights have to be positive")
    period = max(period, 4 * len(names))
    total, free = float(sum(targets.values())), period - len(names)
    exact = {s: targets[s] / total * free for s in names}
    shares = {s: 1 + int(exact[s]) for s in names}
    rest = sorted(names, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))
    for s in rest[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def pfair_period(shares: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block in period, release, deadline, slot) of one period, earliest deadline first."""
    period = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, s or ""))
    release = lambda q, j: j * period // q
    deadline = lambda q, j: -(-(j + 1) * period // q)
    waiting = [(0, k, 0) for k in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    placed = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(shares[names[k]], j), k, j))
        due, k, j = heapq.heappop(ready)
        q = shares[names[k]]
        placed.append((names[k], j, release(q, j), due, slot))
        if j + 1 < q:
            heapq.heappush(waiting, (release(q, j + 1), k, j + 1))
    return placed


def mix(docs: DataFrame, shares: Mapping[str | None, int], block_rows: int = BLOCK_ROWS, source: str = "source", order: str = "doc_id", total: int | None = None) -> DataFrame:
    """Adds ``block``, ``release``, ``deadline``, ``slot`` and ``row_in_block`` to every row, in place of columns of
    these names.

    Every row is kept. Slots of a source that has run out stay empty, so the others
    go on in their own proportions. A null source is a source of its own; sources
    without a share raise an error rather than lose their rows. Within a source,
    rows are dealt to blocks by a hash; rows of equal ``order`` follow a hash of their other columns.
    """
    spark = docs.sparkSession
    period = sum(shares.values())
    rows = [(s, shares[s], j, r, d, t) for s, j, r, d, t in pfair_period(shares)]
    named = lambda *names: pa.schema([(n, pa.string() if n == "__s" else pa.int64()) for n in names])
    plan = small_table(spark, rows, named("__s", "__q", "__j", "__rel", "__due", "__slot"))
    sizes = small_table(spark, list(shares.items()), named("__s", "__q"))
    total = docs.count() if total is None else total
    numbered = number_rows(docs, [source], [order], total, 500, "__i")
    # both tables have at most one row per slot of the bounded period
    at = numbered.join(F.broadcast(sizes.withColumnRenamed("__s", "__s1").withColumnRenamed("__q", "__share")), F.col(source).eqNullSafe(F.col("__s1")), "left")
    at = at.withColumn("block", F.expr(f"__i div {int(block_rows)}")).withColumn("__share", F.coalesce("__share", F.raise_error(F.concat(F.lit("no share for source "), F.coalesce(F.col(source), F.lit("null")))).cast("long")))
    at = at.withColumn("__p", F.expr("block div __share")).withColumn("__jj", F.expr("block % __share"))
    out = at.join(F.broadcast(plan.drop("__q")), F.col(source).eqNullSafe(F.col("__s")) & (F.col("__jj") == F.col("__j")))
    base = F.col("__p") * F.lit(period)
    return out.select(*[c for c in docs.columns if c not in ADDED], F.col("block").cast("long").alias("block"), (base + F.col("__rel")).alias("release"), (base + F.col("__due")).alias("deadline"), (base + F.col("__slot")).alias("slot"), F.expr(f"__i % {int(block_rows)}").cast("long").alias("row_in_block"))


def tempered_shares(docs: DataFrame, source: str = "source", temperature: float = TEMPERATURE) -> dict[str | None, int]:
    """Target weights n ** temperature of the sources, as shares. One row per source reaches the driver; more
    than MOST_SOURCES of them raise an error, as each needs a slot in the period."""
    counts = {r[0]: float(r[1]) ** temperature for r in docs.groupBy(source).count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    return quantise(counts)


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block, window and slot under square-root weights of the sources. A null source is a
    source; null ids and repeated rows are placed like others; an empty table has no rows."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, tempered_shares(docs)).select("doc_id", "source", "block", "release", "deadline", "slot", "row_in_block")
