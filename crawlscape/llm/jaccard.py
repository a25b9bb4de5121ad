"""Exact n-gram Jaccard join by set relations, down to connected components.

A document is the set of its distinct shingles, each a 64-bit hash; equal sets are
one set from the start. With threshold 3/4, two linked sets share at least 3/4 of
the larger one, and so:

1. *Dismissal.* Of the shingles that are smallest by hash, a fixed part of each
   set, a linked set shares a known number with another set. Sets that don't are
   linked with nothing. A batch of rows settles among itself which shingles repeat
   and sends one row for each shingle, so that frequent shingles don't pile up.
2. *Index.* What is left is indexed by its rarest shingles, counted over all sets
   left. Shingles of one set come first in that order and are not listed at all.
   Lists are cut into blocks of sizes; only neighbouring blocks can hold linked
   sets and others are skipped, as are blocks whose positions leave too few
   shingles to share.
3. *Answers from a similar set.* Each set is compared with leaders of its lists.
   Linked sets form a leader's cluster with their Jaccard distance to it. As that
   distance is a metric, the distance of two leaders decides on all pairs of their
   clusters at once, unless it lies within the clusters' radii of the threshold;
   only then pairs of members are verified, and only those that their own distances
   leave open.

The components of the links found are those of all links: a pair that was not
verified is no link, or lies in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, Scratch, bounded_batches, held, hot_keys, let_go, lookup, parquet, tidy
from .graph import components

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
EXTRA = 0.05
ROUNDS, TRIES, CELL, SHRINK = 5, 3, 512, 0.8
LIMIT = 1 - NUMERATOR / DENOMINATOR + 1e-9
MEETING = 256
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
PART_CHARS, REMEMBERED = 1 << 22, 1_000_000
_STEP, _MIX = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    CACHE = 200_000

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def _words(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        known = self.known
        if len(known) > self.CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def _hashed(h: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of all runs of n."""
        last = len(h) - n + 1
        acc = np.full(last, n, np.uint64)
        for j in range(n):
            acc = (acc ^ (acc >> np.uint64(31))) * _STEP + h[j : j + last]
        acc ^= acc >> np.uint64(32)
        acc *= _MIX
        return acc ^ (acc >> np.uint64(29))

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct 64-bit hashes of every text's shingles (of fewer words, the one of all words), one
        text after the other, and the bounds between them."""
        words = [self._words(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        h, n = np.concatenate([*words, np.empty(0, np.uint64)]), self.width
        runs = self._hashed(h, n) if len(h) >= n else np.empty(0, np.uint64)
        counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) + np.repeat(np.cumsum(sizes) - sizes - bounds[:-1], counts)
        flat = runs[np.minimum(at, max(0, len(runs) - 1))] if len(runs) else np.zeros(len(at), np.uint64)
        for i in np.flatnonzero((sizes > 0) & (sizes < n)):
            flat[bounds[i]] = self._hashed(words[i], len(words[i]))[0]
        for i in np.flatnonzero(counts > 1):
            flat[bounds[i] : bounds[i + 1]].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[bounds[:-1][counts > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])[bounds]
        return flat[new], kept


def _shingler(width: int) -> Shingler:
    return held(Shingler, width)


def needed(n: np.ndarray | int):
    """Shingles that a set of n has to share with any linked set."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _extra(n):
    return np.maximum(1, np.floor(EXTRA * n)).astype(np.int64)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - needed(n) + _extra(n))


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shared shingles in the prefix that a linked set can't do without: those of its smallest partner."""
    return _extra(needed(n))


def shingle_sets(df: DataFrame, text: str, keep: list[str], width: int = WIDTH) -> DataFrame:
    """``keep``, ``sid`` (hash of the set; null if empty), ``n_shingles``, ``home`` and ``tokens``. The last two are
    null where the task has met the set before; ``home`` numbers all rows with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingles, seen, home = _shingler(width), set(), TaskContext.get().partitionId() << 36
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            k = 0
            while k < max(1, batch.num_rows):
                texts, size = [], 0
                while k + len(texts) < batch.num_rows and len(texts) < 512 and size < PART_CHARS:
                    texts.append(column[k + len(texts)].as_py())
                    size += len(texts[-1] or "")
                part = batch.slice(k, len(texts))
                k += max(1, len(texts))
                flat, bounds = shingles(texts)
                sids, homes, first = [], [], np.zeros(len(texts), bool)
                for i in range(len(texts)):
                    own = flat[bounds[i] : bounds[i + 1]]
                    sid = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None
                    sids.append(sid)
                    first[i] = sid is not None and sid not in seen
                    home += int(first[i])
                    homes.append(home if first[i] else None)
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(sid)
                sizes = np.diff(bounds)
                offsets = np.concatenate([[0], np.cumsum(np.where(first, sizes, 0))]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[np.repeat(first, sizes)].view(np.int64)), mask=pa.array(~first))
                own = [pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(homes, pa.int64()), tokens]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], names=[*keep, "sid", "n_shingles", "home", "tokens"])

    bounded_batches(df)
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(tidy(run), f"{head}, sid long, n_shingles long, home long, tokens array<long>")


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, sid, settled, known): one row per shingle of the batch. ``known`` counts, once for each set,
    its shingles that repeat within the task; ``settled`` rows stand for such a shingle. A shingle that has a
    settled row gets no further ones, while the task remembers it."""
    let_go()
    settled_before = np.empty(0, np.int64)
    for batch in batches:
        sid = np.asarray(batch.column(0))
        column = batch.column(1)
        if not len(sid):
            continue
        _, firsts = np.unique(sid, return_index=True)
        offsets = np.asarray(column.offsets)
        flat = np.asarray(column.values)
        sizes = (offsets[1:] - offsets[:-1])[firsts]
        take = prefix_size(sizes.astype(np.int64))
        own = np.repeat(np.arange(len(firsts)), take)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(take) - take, take)
        token = flat[offsets[:-1][firsts][own] + inner]
        told_before = _among(token, settled_before)
        known = np.bincount(own[told_before], minlength=len(firsts))
        token, own = token[~told_before], own[~told_before]
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(new)
        count = np.diff([*start, len(token)])
        many = np.repeat(count > 1, count)
        known += np.bincount(own[many], minlength=len(firsts))
        settled = count > 1
        owner = own[start]
        # a set's count travels on its first row; a set without a row of its own gets one
        told = np.zeros(len(start), np.int64)
        holder, at = np.unique(owner, return_index=True)
        told[at] = known[holder]
        rest = np.setdiff1d(np.arange(len(firsts)), holder)
        lone = offsets[:-1][firsts][rest]
        fresh = token[start][settled]
        settled_before = np.union1d(settled_before, fresh) if len(settled_before) < REMEMBERED else np.sort(fresh)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([token[start], flat[lone]])), pa.array(np.concatenate([sid[firsts][owner], sid[firsts][rest]])),
            pa.array(np.concatenate([settled, np.ones(len(rest), bool)])), pa.array(np.concatenate([told, known[rest]])),
        ], names=["token", "sid", "settled", "known"])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _linked(inter: Column, a: Column, b: Column) -> Column:
    return DENOMINATOR * inter >= NUMERATOR * (a + b - inter)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast only for a table of ids that was counted to stay within BROADCAST_BYTES; else a shuffle join."""
    return F.broadcast(df) if rows * ROW_BYTES <= BROADCAST_BYTES else df


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``linked`` and ``dist``, the Jaccard distance, to a written table of pairs (a, b, ...). Only sets that
    have pairs move; the pairs of a set that has very many are dealt over tasks."""
    total = pairs.count()
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("__ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("__tb"))
    few = _few(pairs, total)
    one = left.join(few, "a") if few is not pairs else lookup(pairs, left, ["a"], ["b"], total, "inner")
    right = right.join(_few(pairs.select("b").distinct(), total), "b", "left_semi")
    both = lookup(one, right, ["b"], ["a"], total, "inner", counted=pairs).withColumn("__i", F.size(F.array_intersect("__ta", "__tb")))
    na, nb, i = F.size("__ta"), F.size("__tb"), F.col("__i")
    return both.withColumn("linked", _linked(i, na, nb)).withColumn("dist", 1 - i / (na + nb - i)).drop("__ta", "__tb", "__i")


def _stars(index: DataFrame, kept: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, dist) of sets with leaders of their lists, found in rounds, and the lists that may still
    hold several components.

    At first a list of one block has one leader, and a set takes the leader that most of its lists name.
    Then lists that hold several components name leaders in their largest one, and only sets outside of
    it try them, the few that most lists name, until the lists hardly shrink. The labels between rounds only
    steer the next round."""
    total = index.count()
    leaders = index.groupBy("token", "block").agg(F.min("sid").alias("leader"), F.max("sid").alias("__m")).where("leader <> __m").drop("__m")
    chosen = lookup(index, leaders, ["token", "block"], ["sid"], total, "inner").where("sid <> leader").groupBy("sid", "leader").count()
    chosen = chosen.groupBy("sid").agg(F.max(F.struct("count", F.col("leader").alias("leader"))).alias("c")).select(F.col("sid").alias("a"), F.col("c.leader").alias("b"))
    found = scratch.keep(_verified(scratch.keep(chosen, "tries-0"), kept).where("linked").select("a", "b", "dist"), "stars-0")
    own = found.select(F.col("a").alias("sid"), F.col("b").alias("comp"))
    above = own.select(F.col("sid").alias("comp"), F.col("comp").alias("next"))
    followed = lookup(own, above, ["comp"], ["sid"], found.count()).select("sid", F.coalesce("next", "comp").alias("to"))
    nodes = index.select("sid").distinct()
    labels = scratch.keep(nodes.join(followed, "sid", "left").select("sid", F.coalesce("to", "sid").alias("comp")), "labels-0")
    sets, lists = labels.count(), index
    for k in range(1, ROUNDS):
        placed = lists.join(_few(labels, sets), "sid")
        picks = [F.min_by(F.struct("sid", "n"), F.xxhash64("sid", F.lit(TRIES * k + j))).alias(f"l{j}") for j in range(TRIES)]
        parts = placed.groupBy("token", "comp").agg(F.count("*").alias("size"), *picks)
        major = parts.groupBy("token").agg(F.max_by(F.struct(F.col("comp").alias("major"), *[f"l{j}" for j in range(TRIES)]), F.struct("size", "comp")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", "m.*")
        held = scratch.keep(lookup(placed, major, ["token"], ["sid"], total, "inner", counted=lists), f"lists-{k}")
        lists, before, total = held.select(*index.columns), total, held.count()
        outside = held.where("comp <> major").select("sid", "n", "comp", "major", F.explode(F.array(*[f"l{j}" for j in range(TRIES)])).alias("l"))
        fitting = outside.where((F.col("n") * DENOMINATOR >= F.col("l.n") * NUMERATOR) & (F.col("l.n") * DENOMINATOR >= F.col("n") * NUMERATOR))
        named = fitting.groupBy("sid", "comp", F.col("l.sid").alias("b"), "major").count()
        top = named.groupBy("sid", "comp").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "b", "major")), False), 1, TRIES).alias("t"))
        pairs = scratch.keep(top.select(F.col("sid").alias("a"), "comp", F.explode("t").alias("t")).select("a", "comp", "t.b", "t.major"), f"tries-{k}")
        new = scratch.keep(_verified(pairs, kept).where("linked").select("a", "b", "dist", "comp", "major"), f"stars-{k}")
        found = found.union(new.select("a", "b", "dist"))
        if new.limit(1).count() == 0 or (k > 1 and total > SHRINK * before):
            break
        moved = new.groupBy("comp").agg(F.min("major").alias("to"))
        labels = scratch.keep(lookup(labels, moved, ["comp"], ["sid"], sets).select("sid", F.coalesce("to", "comp").alias("comp")), f"labels-{k}")
    return found, lists


def _member_links(wide: DataFrame, members: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of clusters, of those in ``wide`` (ka, kb, na, nb, apart), some members of which are linked.

    The members of ka, in blocks, meet the members of all its kb, in blocks: a cell compares what the
    distances leave open and stops at a pair's first link. Cells are bounded on either side."""
    per = wide.groupBy("ka").agg(F.max("na").alias("na"), F.sum("nb").alias("others"))
    cut = per.select("ka", F.ceil(F.col("na") / CELL).cast("int").alias("blocks"), F.ceil(F.col("others") / CELL).cast("int").alias("groups"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    tokens, total = kept.select("sid", "tokens"), members.count()
    hot = hot_keys(members, ["cluster"], total)
    one = lookup(members.select("cluster", "sid", "eps"), cut.withColumnRenamed("ka", "cluster"), ["cluster"], ["sid"], total, "inner", hot=hot).withColumnRenamed("cluster", "ka")
    one = scratch.keep(one, "one")
    left = tokens.join(_few(one, one.count()), "sid").withColumn("block", block("sid", "blocks")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    meets = lookup(wide.select("ka", "kb", "apart"), cut, ["ka"], ["kb"], wide.count(), "inner").withColumnRenamed("kb", "cluster")
    two = lookup(members.select("cluster", "sid", "eps"), meets, ["cluster"], ["sid"], total, "inner", hot=hot).withColumnRenamed("cluster", "kb")
    two = scratch.keep(two, "two")
    other = tokens.join(_few(two, two.count()), "sid").withColumn("group", block("sid", "groups")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = other.select(*[F.col(c).alias(f"r_{c}") for c in ("ka", "block", "group", "kb", "apart", "eps", "tokens")])

    def cell(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        let_go()
        found: set = set()
        if len(one) and len(two):
            sizes = one["tokens"].map(len).to_numpy(np.int64)
            flat, owner = np.concatenate(one["tokens"].to_list()), np.repeat(np.arange(len(one)), sizes)
            eps, ka = one["eps"].to_numpy(), int(one["ka"].iloc[0])
            for kb, apart, e, tokens in zip(two["r_kb"], two["r_apart"], two["r_eps"], two["r_tokens"], strict=True):
                if (ka, kb) in found:
                    continue
                n = len(tokens)
                open_ = (apart <= LIMIT + eps + e) & (DENOMINATOR * sizes >= NUMERATOR * n) & (DENOMINATOR * n >= NUMERATOR * sizes)
                if not open_.any():
                    continue
                shared = np.bincount(owner[np.isin(flat, tokens)], minlength=len(one))
                if (open_ & (DENOMINATOR * shared >= NUMERATOR * (sizes + n - shared))).any():
                    found.add((ka, int(kb)))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    keys = ["ka", "block", "group"]
    return left.select(*keys, "eps", "tokens").groupBy(*keys).cogroup(right.groupBy(*[f"r_{k}" for k in keys])).applyInPandas(cell, "a long, b long").distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of clusters (ka, kb, ...) that lie in different components."""
    a = comps.select(F.col("node").alias("ka"), F.col("comp").alias("__ca"))
    b = comps.select(F.col("node").alias("kb"), F.col("comp").alias("__cb"))
    return pairs.join(a, "ka", "left").join(b, "kb", "left").where("coalesce(__ca, ka) <> coalesce(__cb, kb)").drop("__ca", "__cb")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "jaccard") -> DataFrame:
    """(key, n_shingles, component_id): the smallest key reachable by links.

    Null, empty and blank texts have no shingles and are linked with nothing, their
    component is their own key. A null key is never a component's id unless all keys
    of the component are null. Repeated rows are returned each.
    """
    scratch = Scratch(docs.sparkSession, label)
    table = scratch.keep(shingle_sets(docs, text, [key]), "sets")
    light = scratch.keep(table.select(F.col(key).alias("key"), "sid", "n_shingles", "home"), "light")
    whole = table.where("home is not null").select("sid", "home", "tokens")

    sent = whole.select("sid", "tokens").mapInArrow(tidy(_prefix_rows), "token long, sid long, settled boolean, known long")
    by_token = Window.partitionBy("token")
    spread = F.min("sid").over(by_token) != F.max("sid").over(by_token)
    told = sent.withColumn("hit", F.when(spread & ~F.col("settled"), 1).otherwise(0) + F.col("known"))
    shared = told.groupBy("sid").agg(F.sum("hit").alias("hits")).where("hits > 0")
    classes = light.where("sid is not null").groupBy("sid").agg(F.min("key").alias("least"), F.min("home").alias("home"), F.first("n_shingles").alias("n"))
    classes = scratch.keep(classes, "classes")
    floor = F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)))
    left = scratch.keep(shared.join(classes, "sid").where(F.col("hits") >= floor).select("sid", "home", "n"), "left")
    # of the rows that hold a set's tokens one stays, however many tasks have met the set
    kept = scratch.keep(whole.join(_few(left, left.count()), ["sid", "home"]).select("sid", "tokens", "n"), "kept")
    scratch.drop("sets")

    # the index: rarest shingles first, those of a single set counted but not listed
    each = kept.select("sid", "n", F.explode("tokens").alias("token"))
    common = scratch.keep(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "common")
    total = common.agg(F.sum("df")).head()[0] or 0
    often = max(HOT_ROWS, -(-total // HOT_SHARE))
    hot = common.where(F.col("df") > often).select("token", F.ceil(F.col("df") / often).cast("int").alias("__parts"))
    listed = lookup(each, common, ["token"], ["sid"], total, "inner", hot=hot).groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    must = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int")
    alone = F.col("n").cast("int") - F.size("shared")
    listed = listed.where(F.size("shared") >= must).withColumn("alone", alone)
    head = F.slice("shared", 1, F.col("n").cast("int") - must + 1 - F.col("alone"))
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DENOMINATOR / NUMERATOR)))).cast("int")
    index = listed.select("sid", "n", "alone", block.alias("block"), F.posexplode(head).alias("at", "s"))
    index = scratch.keep(index.select("sid", "n", "block", (F.col("alone") + F.col("at")).alias("pos"), F.col("s.token").alias("token")), "index")

    tried, lists = _stars(index, kept, scratch)
    tried = scratch.keep(tried, "tried")
    stars = scratch.keep(tried.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("s")).select("a", "s.b", "s.dist"), "stars")
    pivots = stars.select(F.col("b").alias("pivot")).distinct()
    members = index.select("sid", "n", "block").distinct().join(stars.select(F.col("a").alias("sid"), F.col("b").alias("__l"), "dist"), "sid", "left").join(pivots.select(F.col("pivot").alias("sid"), F.lit(True).alias("__p")), "sid", "left")
    follows = F.col("__p").isNull() & F.col("__l").isNotNull()
    members = scratch.keep(members.select("sid", "n", "block", F.when(follows, F.col("__l")).otherwise(F.col("sid")).alias("cluster"), F.when(follows, F.col("dist")).otherwise(F.lit(0.0)).alias("eps")), "members")
    comps = components(tried, scratch, "first")

    # leaders of clusters in different components that meet in a list
    placed = lists.join(members.select("sid", "cluster"), "sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    runs = scratch.keep(placed.groupBy("token", "block", "cluster", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("pos")), "runs")
    per = runs.groupBy("token").agg(F.min("comp").alias("__a"), F.max("comp").alias("__b"), F.count("*").alias("__n")).where("__a <> __b")
    met = scratch.keep(per.select("token", F.ceil(F.col("__n") / MEETING).cast("int").alias("cuts")), "met")
    runs = lookup(runs, met, ["token"], ["cluster"], runs.count(), "inner")
    # a list's runs in cuts: every two cuts meet in a cell of their own, of MEETING x MEETING pairs or so
    cut = F.pmod(F.xxhash64("cluster"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    x = runs.select("token", "cuts", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("cluster").alias("a"), F.col("comp").alias("ca"), F.col("least").alias("la"), F.col("most").alias("ma"), F.col("pos").alias("pa"), cut.alias("i"))
    x = x.withColumn("j", F.explode(every)).drop("cuts")
    y = runs.select("token", "cuts", "block", F.col("cluster").alias("b"), F.col("comp").alias("cb"), F.col("least").alias("lb"), F.col("most").alias("mb"), F.col("pos").alias("pb"), cut.alias("j"))
    y = y.withColumn("i", F.explode(every)).drop("cuts")
    room = F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb")) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("la") + F.col("lb"))
    fits = (F.col("ma") * DENOMINATOR >= F.col("lb") * NUMERATOR) & (F.col("mb") * DENOMINATOR >= F.col("la") * NUMERATOR)
    meet = x.join(y, ["token", "block", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room & fits)
    judged = scratch.keep(_verified(scratch.keep(meet.select("a", "b").distinct(), "meet"), kept), "judged")

    # pairs of clusters that their leaders' distance leaves open
    radius = members.groupBy("cluster").agg(F.max("eps").alias("r"), F.count("*").alias("size"))
    links = tried.select("a", "b").union(judged.where("linked").select("a", "b"))
    comps = components(links, scratch, "second")
    wide = judged.where("not linked").join(radius.select(F.col("cluster").alias("a"), F.col("r").alias("ra"), F.col("size").alias("na")), "a").join(radius.select(F.col("cluster").alias("b"), F.col("r").alias("rb"), F.col("size").alias("nb")), "b")
    wide = wide.where((F.col("dist") <= LIMIT + F.col("ra") + F.col("rb")) & ((F.col("ra") > 0) | (F.col("rb") > 0)))
    larger = F.col("na") >= F.col("nb")
    wide = wide.select(*[F.when(larger, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("ka", "a", "b"), ("kb", "b", "a"), ("na", "na", "nb"), ("nb", "nb", "na"))], F.col("dist").alias("apart"))
    wide = scratch.keep(_apart(wide, comps), "wide")
    more = scratch.keep(_member_links(wide, members, kept, scratch), "more")
    comps = components(links.union(more), scratch, "third") if more.limit(1).count() else comps

    # back to the documents: classes of equal sets, then components of classes
    tied = comps.join(classes.select(F.col("sid").alias("node"), "least"), "node")
    tops = tied.groupBy("comp").agg(F.min("least").alias("top"))
    topped = lookup(tied, tops, ["comp"], ["node"], comps.count(), "inner", counted=comps).select(F.col("node").alias("sid"), "top")
    named = scratch.keep(classes.select("sid", "least").join(topped, "sid", "left").select("sid", F.coalesce("top", "least").alias("component_id")), "named")
    scratch.only("light", "named")
    full = light.where("sid is not null")
    out = lookup(full, named, ["sid"], ["key"], light.count(), "inner").select(F.col("key").alias(key), "n_shingles", "component_id")
    return out.unionByName(light.where("sid is null").select(F.col("key").alias(key), "n_shingles", F.col("key").alias("component_id")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component under links of at least 3/4."""
    return near_components(parquet(spark, sf_dir, "documents").select("doc_id", "text"))
