"""Exact top-k inner products by norm-bucketed retrieval.

Candidate vectors are grouped by length, in geometric buckets of their norm, and
within a bucket by their largest coordinate, its sign and its share of the length.
What is known of a group (its longest vector, the range of its largest coordinate)
bounds its products with a query, before any vector moves: the bound on a query's
k-th best score over the product of the norms is a local cosine threshold, and the
group is dead to the query if it exceeds 1 or if no unit vector with a coordinate in
that range can reach it. A query meets the most promising cell first, which tightens
its bound, and then the cells of the groups that are still alive; a cell goes only to
as many blocks of queries as it has live ones. Within a cell the threshold picks
coordinate pruning (if high: candidates have to fall into the query's feasible range
in its largest coordinates) or length pruning. Survivors are verified with exact
integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parquet

K, SCALE, QUERY_EVERY = 10, 1024, 100
CELL_ROWS, QUERY_BLOCK, SEEDS = 4096, 1024, 1024
STEEP, FOCUS = 0.8, 3
EXACT = float(1 << 52)
LEVELS, BROADCAST_CELLS, MERGE = 8, 1_000_000, 64


def quantised(embedding: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows, through doubles while every partial sum fits into 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Bounded:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, k: int, count: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * count
        self.ids = [np.empty(0, np.int64)] * count

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k] if len(scores) < 4 * self.k else self._best(scores, ids)
        self.scores[q], self.ids[q] = scores[order], ids[order]

    def _best(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))[: self.k]]

    def floor(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


def search_cell(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int) -> Bounded:
    """Best candidates of one cell for a block of queries; ``floor``: scores below can't be among the k best."""
    order = np.argsort(-np.linalg.norm(p.astype(np.float64), axis=1), kind="stable")
    p, p_ids = p[order], p_ids[order]
    length = np.linalg.norm(p.astype(np.float64), axis=1)
    unit = p / np.maximum(length, 1e-300)[:, None]
    q_length = np.linalg.norm(q.astype(np.float64), axis=1)
    best = Bounded(k, len(q_ids))
    longest = float(length[0]) if len(length) else 0.0
    safe = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        theta = np.where(floor > 0, floor / (q_length * longest), np.where(floor > -np.inf, 0.0, -1.0))
    theta = np.nan_to_num(theta * np.where(theta > 0, safe, 1.0), nan=-1.0)
    for i in np.flatnonzero((theta > STEEP) & (theta <= 1.0)):  # coordinate pruning
        direction = q[i] / q_length[i]
        mask = np.ones(len(p), bool)
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            reach = np.sqrt(max(0.0, 1 - theta[i] ** 2) * max(0.0, 1 - direction[f] ** 2)) + 1e-9
            middle = theta[i] * direction[f]
            lowest = middle - reach if direction[f] >= 0 else -2.0
            highest = middle + reach if direction[f] < 0 else 2.0
            mask &= (unit[:, f] >= lowest) & (unit[:, f] <= highest)
        at = np.flatnonzero(mask & (p_ids != q_ids[i]))
        if len(at):
            best.add(i, _products(q[i : i + 1], p[at])[0], p_ids[at])
    flat = np.flatnonzero(theta <= STEEP)  # length pruning
    for start in range(0, len(flat), 128):
        rows = flat[start : start + 128]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floor[rows] > 0, floor[rows] / q_length[rows] * safe, 0.0)
        reach = np.searchsorted(-length, -np.nan_to_num(least, nan=0.0), side="right")
        scores = _products(q[rows], p[: reach.max(initial=0)])
        for r, i in enumerate(rows):
            s, ids = scores[r, : reach[r]], p_ids[: reach[r]]
            keep = np.flatnonzero((s >= max(floor[i], best.floor(i))) & (ids != q_ids[i]))
            best.add(i, s[keep], ids[keep])
    return best


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``norm`` and the group of a vector: ``bucket`` of its norm, ``focus``, the place of its largest coordinate
    from 1 with its sign (0 for a vector of zeros), ``peak``, that coordinate's share of the length, and its ``level``."""
    sizes = F.transform("v", lambda x: F.abs(x.cast("double")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    rows = rows.withColumn("__top", F.coalesce(F.array_max(sizes), F.lit(0.0))).withColumn("__at", F.array_position(sizes, F.col("__top")).cast("int"))
    some = F.col("norm") > 0
    rows = rows.withColumn("bucket", F.when(some, F.floor(F.log2("norm") * 8)).otherwise(F.lit(-1)).cast("int"))
    rows = rows.withColumn("focus", F.when(some, F.when(F.get("v", F.col("__at") - 1) < 0, -F.col("__at")).otherwise(F.col("__at"))).otherwise(0))
    rows = rows.withColumn("peak", F.when(some, F.col("__top") / F.col("norm")).otherwise(F.lit(0.0)))
    return rows.withColumn("level", F.floor(F.col("peak") * LEVELS).cast("int")).drop("__top", "__at")


class Groups:
    """What bounds the products of groups with queries; their number grows with the vectors' width, not their count."""

    def __init__(self, rows: list, cell_rows: int):
        """rows: (bucket, focus, level, count, longest, lowest peak, highest peak), longest buckets first. Small groups
        share a cell, large ones have several."""
        self.rows, self.first, self.parts = rows, [], []
        cells, filled = 0, 0
        for r in rows:
            parts = -(-r[3] // cell_rows)
            if parts > 1 or filled + r[3] > cell_rows:
                cells, filled = cells + (filled > 0), 0
            self.first.append(cells)
            self.parts.append(parts)
            cells, filled = (cells + parts, 0) if parts > 1 else (cells, filled + r[3])
        self.cells = cells + (filled > 0)
        columns = [np.array(c, float) for c in zip(*(r[1:] for r in rows), strict=True)]
        self.focus, _, _, self.longest, self.low, self.high = columns
        self.at, self.sign = np.maximum(np.abs(self.focus).astype(int) - 1, 0), np.sign(self.focus)
        self.starts, self.counts = np.array(self.first, np.int64), np.array(self.parts, np.int64)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The most that a group's product with a query can be, for rows of queries; never too little."""
        length = np.linalg.norm(q.astype(np.float64), axis=1)
        unit = q / np.maximum(length, 1e-300)[:, None]
        wide = np.zeros((len(q), max(q.shape[1], int(self.at.max()) + 1)))
        wide[:, : q.shape[1]] = unit
        along = wide[:, self.at] * self.sign
        nearest = np.clip(along, self.low - 1e-9, self.high + 1e-9)
        cosine = along * nearest + np.sqrt(np.maximum(0, 1 - along**2)) * np.sqrt(np.maximum(0, 1 - nearest**2))
        cosine = np.minimum(cosine, np.abs(unit).sum(1)[:, None] * self.high)
        return length[:, None] * self.longest * (np.clip(cosine, 0, 1) + 1e-9)


def _met(dealt: DataFrame, placed: DataFrame, cells: int, k: int, query_block: int) -> DataFrame:
    """(query_id, vec_id, score, cell): the best of each cell for the queries dealt to it. Cells and blocks of
    queries are bounded; a cell is copied to the blocks it has queries for, and to no other."""
    blocks = dealt.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks) if cells <= BROADCAST_CELLS else blocks
    left = dealt.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    right = placed.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "vec_id", "v")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "cell": []}, dtype="int64")
        wide = max(max(map(len, left["q"])), max(map(len, right["v"])))
        own = left["query_id"].to_numpy(np.int64)
        found = search_cell(own, _matrix(left["q"], wide), left["bound"].to_numpy(float), right["vec_id"].to_numpy(np.int64), _matrix(right["v"], wide), k)
        sizes = [len(s) for s in found.scores]
        return pd.DataFrame({"query_id": np.repeat(own, sizes), "vec_id": np.concatenate(found.ids).astype("int64"), "score": np.concatenate(found.scores).astype("int64"), "cell": int(left["cell"].iloc[0])})

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(cell, "query_id long, vec_id long, score long, cell long")


def _best(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id", *more).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, cell_rows: int = CELL_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for frames of (vec_id, v array<long>).

    Vectors and ids that are null take no part; shorter vectors count as padded with
    zeros; a query's own id is no candidate; scores beyond 64 bits saturate; ties go to
    the smaller id. Rows that repeat a candidate's id are ranked each, and the rows of
    one query id share one ranking. The driver sees one row per group (their number is
    bounded by the vectors' width) and SEEDS vectors.
    """
    spark = candidates.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = grouped(candidates.where("v is not null and vec_id is not null"))
    peak = [F.count("*"), F.max("norm"), F.min("peak"), F.max("peak")]
    known = rows.groupBy("bucket", "focus", "level").agg(*peak).orderBy(F.col("bucket").desc(), "focus", "level").collect()
    asked = queries.where("v is not null and vec_id is not null").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    if not known or asked.limit(1).count() == 0:
        return empty
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = sum(r[3] for r in known)
    groups = Groups([tuple(r) for r in known], min(cell_rows, max(256, -(-total // spread))))
    # bounded like the list of groups
    place = spark.createDataFrame([(*r[:3], f, n) for r, f, n in zip(groups.rows, groups.first, groups.parts, strict=True)], "bucket int, focus int, level int, __first int, __parts int")
    placed = rows.join(F.broadcast(place), ["bucket", "focus", "level"]).select("vec_id", "v", (F.col("__first") + F.pmod(F.xxhash64("vec_id"), F.col("__parts"))).cast("long").alias("cell"))

    seeds = [(r[0], r[1]) for r in rows.orderBy(F.col("norm").desc(), "vec_id").limit(SEEDS).select("vec_id", "v").collect()]  # SEEDS rows at most
    width = max(len(v) for _, v in seeds)
    seed_ids = np.array([i for i, _ in seeds], np.int64)
    seed_rows = [np.array(v, np.int64) for _, v in seeds]

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            wide = max([width, *(len(v) for v in pdf["q"])])
            q, own = _matrix(pdf["q"], wide), pdf["query_id"].to_numpy(np.int64)
            scores = _products(q, _matrix(pd.Series(seed_rows), wide))
            bounds = []
            for i in range(len(pdf)):
                s = scores[i][seed_ids != own[i]]
                bounds.append(float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else float("-inf"))
            likely = groups.reach(q).argmax(1)
            yield pdf.assign(bound=bounds, cell=groups.starts[likely] + own % groups.counts[likely])

    def alive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            live = groups.reach(_matrix(pdf["q"], max(1, *map(len, pdf["q"])))) >= pdf["bound"].to_numpy(float)[:, None]
            spans = [sorted({(int(groups.starts[g]), int(groups.starts[g] + groups.counts[g] - 1)) for g in np.flatnonzero(row)}) for row in live]
            yield pdf.assign(live=[[{"a": a, "b": b} for a, b in s] for s in spans])

    scratch = Scratch(spark, "top-k")
    plan = "query_id long, q array<long>, bound double, cell long"
    first = scratch.keep(asked.mapInPandas(seeded, plan), "first")
    near = scratch.keep(_met(first, placed, groups.cells, k, query_block), "near")
    tight = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("__tight"))
    sharper = first.join(tight, "query_id", "left").withColumn("bound", F.greatest("bound", F.coalesce("__tight", "bound"))).select("query_id", "q", "bound", "cell")
    second = scratch.keep(sharper.mapInPandas(alive, f"{plan}, live array<struct<a: long, b: long>>"), "second")
    spans = second.select("query_id", "q", "bound", F.col("cell").alias("__own"), F.explode("live").alias("s"))
    dealt = spans.withColumn("cell", F.explode(F.sequence("s.a", "s.b"))).where("cell <> __own").select("query_id", "q", "bound", "cell")
    found = near.unionByName(_met(dealt, placed, groups.cells, k, query_block))
    # a query may have as many as k rows of every cell: ranked among the cells of a part before all of them
    parts = _best(found.withColumn("__part", F.col("cell") % MERGE), k, "__part").drop("rank")
    return _best(parts, k).select("query_id", "rank", "vec_id", "score")


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer products of every hundredth vector with all others.

    Null vectors, vectors with null or non-finite components and null ids take no part; ties go to the smaller
    id; repeated rows are candidates each; an empty table has no rows.
    """
    rows = parquet(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("v"))
    return top_k(rows.where(F.col("vec_id") % QUERY_EVERY == 0), rows)


OP2_SQL = f"""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
