"""Document fingerprints from closed syncmers of words.

A k-mer of K words is an anchor when the smallest of its inner runs of S words
lies at one of its edges, which depends on the k-mer alone: equal passages give
equal anchors wherever they stand. A text is described by its distinct anchors and
the word each one first stands at. Two texts are matched by position: an anchor of
both counts if a neighbouring one lies at the same distance in both texts, so that
runs of anchors in the same order and spacing count and single chance hits do not.
Likeness is the share of these among all anchors of the two. The printed
fingerprint is short, the 128 smallest hashes. Everything is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, parquet

K, S, SKETCH, FEW = 5, 2, 128, 4
RANGE_ROWS, CUTS, HOT_SHARE = 1000, 1024, 10_000
PLACE = 30  # bits of a position


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct anchors of a text as sorted longs, a hash of 32 bits above the first position of the
    anchor, in words from 0.

    A text of fewer than K words, or with fewer than four anchors, is described by its
    words too, each at its own position. No words: no anchors. A null text has null.
    """
    words, hashes, runs, found, every = (f"__{out}_{x}" for x in ("w", "h", "m", "a", "e"))
    df = df.withColumn(words, F.filter(F.split(F.lower(F.col(text)), "\\s+"), lambda w: F.length(w) > 0))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    h = F.col(hashes)
    size = F.size(h)
    none = F.array().cast("array<bigint>")
    df = df.withColumn(runs, F.when(size >= S, F.transform(F.sequence(F.lit(0), size - S), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(none))
    m = F.col(runs)
    last = K - S

    def edge(i: Column) -> Column:
        inner = F.least(*[F.get(m, i + j) for j in range(1, last)])
        return F.least(F.get(m, i), F.get(m, i + last)) <= inner

    starts = F.when(size >= K, F.filter(F.sequence(F.lit(0), size - K), edge)).otherwise(F.array().cast("array<int>"))
    placed = lambda mark, i: F.shiftleft(F.shiftrightunsigned(mark, 32), PLACE).bitwiseOR(i.cast("long"))
    mer = lambda i: placed(F.xxhash64(*[F.get(m, i + j) for j in (*range(0, last, S), last)]), i)
    df = df.withColumn(found, starts)
    a = F.col(found)
    words_too = F.transform(h, lambda x, i: placed(F.xxhash64(x), i))
    all_of = F.concat(F.transform(a, mer), F.when(F.size(a) < FEW, words_too).otherwise(none))
    df = df.withColumn(every, F.sort_array(all_of))
    first = lambda x, i: (i == 0) | (_mark(x) != F.coalesce(_mark(F.get(F.col(every), i - 1)), F.lit(-1)))
    return df.withColumn(out, F.filter(every, first)).drop(hashes, runs, found, every)


def _mark(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the share of anchors that are matched by position, from 0 to 1; two texts without anchors are alike."""
    both, pairs = f"__{out}_b", f"__{out}_p"
    low = (1 << PLACE) - 1
    tagged = lambda c, tag: F.transform(c, lambda x: F.shiftleft(_mark(x), PLACE + 1).bitwiseOR(F.lit(tag << PLACE)).bitwiseOR(x.bitwiseAND(F.lit(low))))
    df = df.withColumn(both, F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))))
    e = F.col(both)
    # an anchor of both texts stands next to itself; a pair holds its places in a and in b
    met = F.filter(F.transform(e, lambda x, i: F.when(F.shiftright(x, PLACE + 1) == F.shiftright(F.get(e, i + 1), PLACE + 1), F.shiftleft(x.bitwiseAND(F.lit(low)), PLACE).bitwiseOR(F.get(e, i + 1).bitwiseAND(F.lit(low))))), lambda x: x.isNotNull())
    df = df.withColumn(pairs, F.sort_array(met))
    p = F.col(pairs)
    offset = lambda x: F.shiftright(x, PLACE) - x.bitwiseAND(F.lit(low))
    beside = lambda x, i: F.coalesce(offset(F.get(p, i - 1)) == offset(x), F.lit(False)) | F.coalesce(offset(F.get(p, i + 1)) == offset(x), F.lit(False))
    lone = (F.size(a) == 1) & (F.size(b) == 1)
    matched = F.when(lone, F.size(p)).otherwise(F.size(F.filter(p, beside)))
    total = F.size(a) + F.size(b)
    return df.withColumn(out, F.when(total == 0, F.lit(1.0)).otherwise(matched / (total - matched))).drop(both, pairs)


def as_text(anchors: str) -> Column:
    """The SKETCH smallest hashes in hexadecimal digits."""
    return F.array_join(F.transform(F.slice(anchors, 1, SKETCH), lambda x: F.lpad(F.lower(F.hex(_mark(x))), 8, "0")), "")


def _cuts(light: DataFrame, order: str, total: int) -> tuple[DataFrame, Column]:
    """(outer, cuts): an outer range of ``order`` and the bounds of the ranges in it. There are at most CUTS outer
    ranges of at most CUTS ranges each, of RANGE_ROWS rows as long as that is enough."""
    count = -(-total // RANGE_ROWS)
    outer = max(1, min(CUTS, -(-count // CUTS)))
    inner = max(1, min(CUTS, -(-count // outer)))
    bounds = light.agg(F.percentile_approx(order, [i / outer for i in range(1, outer)] or [0.5], 10_000)).head()[0] or []  # CUTS at most
    bounds = sorted(set(bounds)) if outer > 1 else []
    of = _outer(order, bounds)
    parts = light.where(F.col(order).isNotNull()).groupBy(of.alias("__outer")).agg(F.percentile_approx(order, [i / inner for i in range(1, inner)] or [0.5], 10_000).alias("__cuts"))
    cuts = parts.select("__outer", F.array_distinct("__cuts").alias("__cuts") if inner > 1 else F.array().cast("array<bigint>").alias("__cuts"))
    return cuts, of


def _outer(order: str, bounds: list) -> Column:
    return F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda c: c <= F.col(order))) if bounds else F.lit(0)


def with_next(df: DataFrame, order: str, carried: list[str], light: DataFrame, tie: str, add: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds ``next_<c>`` of the row that follows in descending ``order``, nulls last, and then by ascending ``tie``,
    a hash; after the last row the first. ``add`` adds columns to carry to every row once.

    Rows are dealt to ranges of ``order``, an id with very many rows to a range of its
    own in parts of ``tie``, and each range looks one row ahead; into each range goes a
    copy of the row that the next one begins with, so that no join or global sort is
    needed. ``light`` has the same rows with (order, tie). The driver sees CUTS bounds
    and the ids of more than a HOT_SHARE-th of the rows, fewer than HOT_SHARE; a range
    table of at most CUTS x CUTS rows is broadcast.
    """
    total = light.count()
    cuts, of = _cuts(light, order, total)
    cuts = Scratch(df.sparkSession, "next").keep(cuts, "cuts")  # written, since cuts drawn again could differ
    often = max(RANGE_ROWS, -(-total // HOT_SHARE))
    hot = {r[0]: -(-r[1] // often) for r in light.groupBy(order).count().where(F.col("count") > often).collect()}
    alone = [h for h in hot if h is not None]
    parts = F.lit(1)
    for h, n in hot.items():
        parts = F.when(F.col(order).eqNullSafe(F.lit(h)), F.lit(n)).otherwise(parts)

    def ranged(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("__outer", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(of)).join(F.broadcast(cuts), "__outer", "left")
        inner = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(order))), F.lit(0))
        apart = F.size(F.filter(F.lit([x for h in alone for x in (h, h + 1)]).cast("array<bigint>"), lambda c: c <= F.col(order))) if alone else F.lit(0)
        share = F.col(tie).cast("double") / F.lit(float(1 << 64)) + 0.5
        part = F.least(F.floor(share * parts), parts - 1) if hot else F.lit(0)
        turn = F.struct(F.col("__outer").alias("o"), F.when(F.col(order).isNull(), F.lit(-1)).otherwise(inner + apart).alias("i"), (-part).cast("int").alias("p"))
        return placed.withColumn("__range", turn).drop("__outer", "__cuts")

    head = F.max(F.struct(F.col(order).isNotNull(), F.col(order).alias("id"), (-F.col(tie).cast("decimal(20,0)")).alias("tie")))
    tops = ranged(light).groupBy("__range").agg(head.alias("h")).select("__range", F.col("h.id").alias("__id"), (-F.col("h.tie")).cast("long").alias("__tie"))
    # one row per range, at most CUTS x CUTS and those of frequent ids
    ring = Window.orderBy(F.col("__range").desc())
    whole = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = tops.select(F.coalesce(F.lag("__range").over(ring), F.last("__range").over(whole)).alias("__into"), F.col("__id").alias("__id"), "__tie")
    copies = df.join(F.broadcast(heads), F.col(order).eqNullSafe(F.col("__id")) & F.col(tie).eqNullSafe(F.col("__tie"))).withColumn("__range", F.col("__into")).drop("__into", "__id", "__tie")
    dealt = ranged(df).withColumn("__copy", F.lit(0)).unionByName(copies.dropDuplicates(["__range"]).withColumn("__copy", F.lit(1)))
    dealt = add(dealt.repartition("__range"))
    ahead = Window.partitionBy("__range").orderBy(F.col("__copy"), F.col(order).desc_nulls_last(), F.col(tie))
    return dealt.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in carried]).where("__copy = 0").drop("__copy", "__range")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    A null text is empty; an empty text has an empty fingerprint; documents of equal id
    follow each other by a hash of their text; a single document is its own next one;
    a null id comes last; repeated rows stay. An empty table has no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    both = with_next(rows, "doc_id", ["text", "anchors"], rows.select("doc_id", "tie"), "tie", lambda d: with_anchors(d, "text", "anchors"))
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("__half", F.expr("cast(n_chars div 2 as int)"))
    both = both.withColumn("__edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - __half)"), F.expr("substring(next_text, 1, __half)"))).drop("text", "next_text")
    both = with_anchors(both, "__edited", "edited_anchors")
    both = with_likeness(both, "anchors", "edited_anchors", "near_edited")
    both = with_likeness(both, "anchors", "next_anchors", "near_next")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, as ``fingerprints`` defines them for nulls, ties, repeated rows and empty tables."""
    return fingerprints(parquet(spark, sf_dir, "documents"))
