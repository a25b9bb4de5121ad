import math

import pytest
from pyspark.sql import functions as F

from crawlscape.llm import topk


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(1024 * x) for x in v]
    out = {}
    for q in ok:
        if q % 3 == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)[:k]
            out[q] = [(n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return out


@pytest.mark.parametrize("scale", [1.0, 0.0, 1e5])
def test_equals_brute_force(spark, scale):
    import random

    rng = random.Random(int(scale))
    rows = [(i, [float(rng.gauss(0, 1) * scale * (1 + i % 5)) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # many equal vectors
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised("embedding").alias("v"))
    got: dict = {}
    for r in topk.top_k(df.where(F.col("vec_id") % 3 == 0), df, 10, cell_rows=40, query_block=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").select("vec_id", topk.quantised("embedding").alias("v"))
    assert [tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_repeated_ids_and_null_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (None, [9.0, 9.0]), (2, [-4.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised("embedding").alias("v"))
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df.where("vec_id = 0"), df, 4).collect())
    own = [[1024, 2048], [3072, -1024]]
    scores = sorted((-sum(a * int(1024 * b) for a, b in zip(q, v, strict=True)), i) for q in own for i, v in rows if i not in (0, None))
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]


def test_groups_are_dropped_before_vectors_move(spark):
    """Short vectors can't reach a query's bound: their cells get no copy of it."""
    import numpy as np

    rng = np.random.default_rng(3)
    known = [(40, f, 3, 100, 40.0, 0.3, 0.5) for f in (1, 2, -1)] + [(8, f, 3, 5000, 2.0, 0.3, 0.5) for f in (1, 2, -1)]
    groups = topk.Groups(known, 1000)
    assert groups.cells == 1 + 3 * 5 and groups.first[:3] == [0, 0, 0] and groups.parts == [1, 1, 1, 5, 5, 5]
    q = rng.normal(0, 1, (50, 6))
    reach = groups.reach(q)
    assert (reach[:, :3] > reach[:, 3:]).all() and (reach[:, 3:] <= 2.0001 * np.linalg.norm(q, axis=1)[:, None]).all()


def test_reach_is_never_too_little():
    import numpy as np

    rng = np.random.default_rng(4)
    for width in (1, 2, 5, 40):
        p = np.floor(rng.normal(0, 1, (400, width)) ** 3 * 1024).astype(np.int64)
        norm = np.linalg.norm(p.astype(float), axis=1)
        at = np.abs(p).argmax(1)
        peak = np.abs(p).max(1) / np.maximum(norm, 1e-300)
        keys = [(0, int((at[i] + 1) * np.sign(p[i, at[i]])), int(peak[i] * topk.LEVELS)) for i in range(len(p))]
        known = [(*g, keys.count(g), max(norm[i] for i in range(400) if keys[i] == g), min(peak[i] for i in range(400) if keys[i] == g), max(peak[i] for i in range(400) if keys[i] == g)) for g in sorted(set(keys))]
        groups = topk.Groups(known, 50)
        q = np.floor(rng.normal(0, 1, (30, width)) * 1024).astype(np.int64)
        reach, scores = groups.reach(q), q @ p.T
        for g, row in enumerate(known):
            own = [i for i in range(400) if keys[i] == row[:3]]
            assert (scores[:, own].max(1) <= reach[:, g]).all()
