import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlscape.llm import fingerprints as fp


def h64(*values):
    """Chained 64-bit hashes as the engine's xxhash64 makes them, from seed 42."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return int(np.uint64(seed).astype(np.int64))


def brute(text):
    """Anchors of a text with the word each one first stands at."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    h = [h64(w) for w in words]
    m = [h64(h[i], h[i + 1]) for i in range(len(h) - 1)]
    starts = [i for i in range(len(h) - fp.K + 1) if min(m[i : i + 4]) in (m[i], m[i + 3])]
    marks = [((h64(m[i], m[i + 2], m[i + 3]) % (1 << 64)) >> 32, i) for i in starts]
    if len(marks) < fp.FEW:
        marks += [((h64(x) % (1 << 64)) >> 32, i) for i, x in enumerate(h)]
    found = {}
    for x, i in sorted(marks):
        found.setdefault(x, i)
    return found


def printed(text):
    return "".join(f"{x:08x}" for x in sorted(brute(text))[: fp.SKETCH])


def likeness(a, b):
    a, b = brute(a), brute(b)
    pairs = sorted((a[x], b[x]) for x in a.keys() & b.keys())
    offset = [i - j for i, j in pairs]
    kept = len(pairs) if len(a) == len(b) == 1 else sum(offset[k] in (offset[k - 1] if k else None, *offset[k + 1 : k + 2]) for k in range(len(pairs)))
    return kept / (len(a) + len(b) - kept) if a or b else 1.0


def edit(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def check(spark, rows, got):
    """rows: (doc_id, text) in any order; got: rows of the query."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h64(r[1] or "")))
    wanted = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = edit(t, after)
        wanted.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(t), printed(edited), likeness(t, edited), likeness(t, after)))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(wanted)


def test_anchors_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["", "a", "a b c d e", "x " * 50] + [" ".join(f"w{rng.randrange(90)}" for _ in range(n)) for n in (4, 5, 6, 30, 900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    got = {r.k: [(x >> fp.PLACE, x % (1 << fp.PLACE)) for x in r.f] for r in fp.with_anchors(df, "text", "f").collect()}
    assert got == {i: sorted(brute(t).items()) for i, t in enumerate(texts)}


def test_anchors_do_not_depend_on_their_place(spark):
    core = " ".join(f"c{i}" for i in range(60))
    df = spark.createDataFrame([("one two " + core,), ("x " * 30 + core + " y z",)], "text string")
    a, b = [{x >> fp.PLACE: x % (1 << fp.PLACE) for x in r.f} for r in fp.with_anchors(df, "text", "f").collect()]
    shared = a.keys() & b.keys()
    assert len(shared) >= 0.6 * len(a) and {b[x] - a[x] for x in shared} == {28}


def test_order_and_spacing_count(spark):
    """A passage moved as a whole is matched; single anchors strewn over a text are not."""
    words = [f"w{i}" for i in range(200)]
    strewn = [x for k in range(0, 200, 7) for x in (*words[k : k + 5], f"a{k}", f"b{k}", f"c{k * k}")]
    rows = [(" ".join(words), " ".join(["x", "y", *words])), (" ".join(words), " ".join(strewn)), (" ".join(words), " ".join(words)), ("", ""), ("one", "one"), ("one", "two")]
    df = fp.with_anchors(fp.with_anchors(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    got = [r.l for r in fp.with_likeness(df, "x", "y", "l").collect()]
    assert got == [likeness(a, b) for a, b in rows] and got[0] > 0.95 and got[1] < 0.1 and got[2:] == [1.0, 1.0, 1.0, 0.0]


def test_next_text_and_edges(spark, edge, nothing, tmp_path):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, rows, fp.op6_closed_syncmers(spark, str(tmp_path)).collect())
    assert len(rows) > len(set(rows))  # repeated rows are in it
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fp.op6_closed_syncmers(spark, str(tmp_path / "none")).count() == 0


def test_all_documents_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, fp.op6_closed_syncmers(spark, sf).collect())


def test_likeness_counts_every_anchor_of_long_texts(spark):
    rng = random.Random(3)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(150)]
    long = [" ".join([*(f"{p}{rng.randrange(10**6)}" for _ in range(3000)), *shared, *(f"{p}{rng.randrange(10**6)}" for _ in range(3000))]) for p in "ab"]
    got = fp.fingerprints(spark.createDataFrame([(2, long[0]), (1, long[1])], "doc_id long, text string")).collect()
    assert all(r.near_next > 0 and len(r.fingerprint) == 8 * fp.SKETCH for r in got)
    check(spark, [(2, long[0]), (1, long[1])], got)


@pytest.mark.parametrize("cuts", [1024, 7])
def test_many_ranges_and_frequent_ids(spark, monkeypatch, cuts):
    """Ranges of ten rows, nested in two levels, and ids and nulls that fill many ranges in parts."""
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    monkeypatch.setattr(fp, "CUTS", cuts)
    rows = [(i * 17 % 300, f"t{i}") for i in range(300)] + [(150, f"same {i}") for i in range(90)] + [(None, f"none {i}") for i in range(60)] + [(7, "all equal")] * 3
    rng = random.Random(9)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("tie", F.xxhash64("text"))
    got = fp.with_next(df, "doc_id", ["text"], df.select("doc_id", "tie"), "tie").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h64(r[1])))
    wanted = [(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == sorted((str(a), b, c) for a, b, c in wanted)
