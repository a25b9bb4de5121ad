"""Connected components by contraction; links never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

CHUNK = 1 << 17


def _stars_of(lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Links from every node to the smallest one that these links alone reach."""
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(above := parent[parent], parent):
            parent = above
    moved = parent != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[parent[moved]]), pa.array(nodes[moved])], names=["lo", "hi"])


def _contracted(chunk: int):
    """The same components, with the links of each ``chunk`` of a task made to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, size = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                part = batch.slice(k, chunk)
                lo.append(np.asarray(part.column(0)))
                hi.append(np.asarray(part.column(1)))
                size += part.num_rows
                if size >= chunk:
                    yield _stars_of(np.concatenate(lo), np.concatenate(hi))
                    lo, hi, size = [], [], 0
        if size:
            yield _stars_of(np.concatenate(lo), np.concatenate(hi))

    return run


def components(links: DataFrame, scratch: Scratch, name: str, chunk: int = CHUNK) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b) between two nodes; comp is the smallest node that can be reached.

    Every task first makes stars of the links it holds, a chunk at a time. Then, in a
    round, every node points to its smallest neighbour below it, pointers jump until
    they show roots, and every link moves to the roots of its ends; links within a root
    are gone. A root that no node points to has a neighbour with a smaller root and goes
    in the next round, so that the nodes left halve every two rounds and pointers settle
    in a number of jumps that is the logarithm of their depth. There is no cap: rounds
    go on until no link is left. The pointers of the rounds are put together at the end,
    last round first. Nodes with very many links are dealt over many tasks. Every step
    is a table in the shared folder.
    """
    ordered = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()
    edges = scratch.keep(ordered.mapInArrow(_contracted(chunk), "lo long, hi long"), f"{name}-edges-0")
    pointers: list[DataFrame] = []
    while total := edges.count():
        k = len(pointers)
        up = scratch.keep(edges.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("up")), f"{name}-up-{k}-0")
        jumps, moving = 0, True
        while moving:
            jumps += 1
            above = up.select(F.col("v").alias("up"), F.col("up").alias("next"))
            jumped = lookup(up, above, ["up"], ["v"], total).select("v", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
            new = scratch.keep(jumped, f"{name}-up-{k}-{jumps}")
            moving = bool(new.where("moved").limit(1).count())
            up = new.select("v", "up")
        pointers.append(up)
        high = lookup(edges, up.select(F.col("v").alias("hi"), F.col("up").alias("top")), ["hi"], ["lo"], total).select("lo", F.coalesce("top", "hi").alias("hi"))
        both = lookup(high, up.select(F.col("v").alias("lo"), F.col("up").alias("top")), ["lo"], ["hi"], total, counted=edges).select(F.coalesce("top", "lo").alias("lo"), "hi")
        moved = both.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo <> hi").distinct()
        edges = scratch.keep(moved.mapInArrow(_contracted(chunk), "lo long, hi long"), f"{name}-edges-{k + 1}")
    if not pointers:
        return edges.select(F.col("lo").alias("node"), F.col("hi").alias("comp"))
    found = pointers[-1]
    for k in range(len(pointers) - 2, -1, -1):
        own = pointers[k]
        settled = lookup(own, found.select(F.col("v").alias("up"), F.col("up").alias("next")), ["up"], ["v"], own.count()).select("v", F.coalesce("next", "up").alias("up"))
        found = scratch.keep(settled.union(found), f"{name}-found-{k}")
    roots = found.select("up").distinct().select(F.col("up").alias("v"), "up")
    return scratch.keep(found.union(roots).select(F.col("v").alias("node"), F.col("up").alias("comp")), f"{name}-components")
