import random

import pytest
from pyspark.sql import functions as F

from crawlscape.llm import common, jaccard
from crawlscape.llm.common import Scratch
from crawlscape.llm.graph import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [k]
        out.append((k, len(sets[i]), min(own, default=None) if own != [None] else None))
    return out


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for family in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 20, 60])))))
        rows.append((len(rows), rows[-1][1].upper()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(edge).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert jaccard.near_components(nothing).count() == 0


def pairs_of(spark, links):
    return spark.createDataFrame(links, "a long, b long").repartition(5)


def reached(links):
    parent = {x: x for pair in links for x in pair}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def shapes():
    rng = random.Random(4)
    ids = rng.sample(range(10**9), 5000)
    shuffled = [(a, b) for a, b in zip(ids, ids[1:], strict=False)]
    reverse = [int(f"{i:012b}"[::-1], 2) for i in range(4096)]
    bits = [(a, b) for a, b in zip(reverse, reverse[1:], strict=False)]
    tree = [(ids[i], ids[rng.randrange(i)]) for i in range(1, 3000)]
    apart = [(ids[i], ids[i + 1]) for i in range(0, 4000, 2)]
    return {"shuffled chain": shuffled, "bit-reversed chain": bits, "random tree": tree, "pairs": apart, "falling chain": [(i + 1, i) for i in range(700)]}


@pytest.mark.parametrize("name", list(shapes()))
def test_components_settle(spark, name):
    links = shapes()[name]
    got = {r.node: r.comp for r in components(pairs_of(spark, links), Scratch(spark, "shape"), "c").collect()}
    assert got == reached(links)


def test_rounds_of_components(spark):
    """Chunks of one link: nothing is contracted within tasks, so that all work is left to the rounds."""
    links = shapes()["shuffled chain"][:1200]
    got = {r.node: r.comp for r in components(pairs_of(spark, links), Scratch(spark, "rounds"), "c", chunk=1).collect()}
    assert got == reached(links)


def test_components_of_stars_and_loops(spark):
    hub = 70_000  # smaller and larger leaves around one node
    star = spark.range(100_000).where(f"id <> {hub}").select(F.col("id").alias("a"), F.lit(hub).cast("long").alias("b"))
    out = components(star, Scratch(spark, "star"), "c")
    assert out.count() == 100_000 and out.where("comp <> 0").count() == 0
    assert components(pairs_of(spark, [(3, 3)]), Scratch(spark, "loop"), "c").count() == 0
    assert components(pairs_of(spark, [(3, 3), (3, 4), (4, 3)]), Scratch(spark, "loop"), "c").count() == 2


def test_sliding_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(2000 * 4 + 40)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 40])) for i in range(2000)]
    rng = random.Random(5)
    ids = rng.sample(range(10**6), len(rows))
    df = spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()}
    assert got == {i: (36, min(ids)) for i in ids}


def test_frequent_shingles_and_hot_groups(spark, monkeypatch):
    """Boilerplate that makes up most of a text, a large group of copies and one of near copies; with every
    key above a few rows dealt over parts and lists cut."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "MEETING", 4)
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    rng = random.Random(6)
    line = [f"b{i}" for i in range(30)]
    rows = []
    for _ in range(60):
        rows.append(" ".join([*line, *(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 12, 40])))]))
    base = [f"c{i}" for i in range(60)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"y{rng.randrange(40)}"
        rows.append(" ".join(words))
    rows += ["the same text in every one of these rows"] * 50
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()]
    assert sorted(got) == sorted(brute(rows))
