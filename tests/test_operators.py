import hashlib
import heapq
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscape.operators import admission, costs, dedup, importance, outcomes, placement, scheduling
from crawlscape.plans import content, graph, history, web
from crawlscape.schema import Elasticity
from crawlscape.storage import cutter


def test_filters_have_no_false_negatives():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    absent = keys + np.uint64(1)
    bloom = dedup.BlockedBloom(len(keys))
    bloom.add(keys)
    ribbon = dedup.Ribbon(keys)
    for made, rate in ((bloom, 0.03), (ribbon, 0.02)):
        again = dedup.load_filter(made.dump())
        assert again.maybe(keys).all() and again.maybe(absent).mean() <= rate
    assert 8 <= bloom.bits_per_key() <= 16 and ribbon.bits_per_key() < 9


def test_ribbon_is_built_in_little_memory(monkeypatch):
    monkeypatch.setattr(dedup, "STEP", 1000, raising=False)
    keys = np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tracemalloc.start()
    ribbon = dedup.Ribbon(keys)
    most = tracemalloc.get_traced_memory()[1] / len(keys)
    tracemalloc.stop()
    assert most < 120 and ribbon.maybe(keys).all()
    assert hashlib.md5(dedup.Ribbon(keys[:5000]).dump()).hexdigest() == "2aab115baf248cfad1a5b8b30b1c3977"  # the bytes of filters written before


def test_filter_join(spark):
    keys = spark.range(3000).select(F.col("id").alias("k"))
    for kind in ("bloom", "ribbon"):
        filters = dedup.build_filters(keys, "k", 4, kind)
        hit = dedup.probe_filters(spark.range(6000).select(F.col("id").alias("k")), "k", filters, 4)
        assert hit.where("k < 3000 and not maybe_seen").count() == 0
        assert hit.where("k >= 3000 and maybe_seen").count() < 3000 * 0.03


def test_first_sightings_and_classes(spark):
    batch = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30), ("c", 4, 40)], "k string, seq int, v int")
    seen = spark.createDataFrame([("b",), ("b",)], "k string")
    assert {(r.k, r.v) for r in dedup.first_sightings(batch, seen, ["k"], "seq").collect()} == {("a", 10), ("c", 40)}
    assert {r.seq: r.unique for r in dedup.classify_batch(batch, seen, ["k"], "seq").collect()} == {1: True, 2: False, 3: False, 4: True}
    assert dedup.seen_union(batch, seen, ["k"]).count() == 3


def test_closed_form_dispatch_is_the_replay(spark):
    rng = random.Random(4)
    rows = [(f"h{rng.randrange(6)}", i, rng.randrange(4) * 10, rng.random(), i) for i in range(60)]
    delays = {h: d for h, _, d, _, _ in rows}
    rows = [(h, u, delays[h], p, s) for h, u, _, p, s in rows]
    timed = {r.url: r.at for r in scheduling.dispatch_times(spark.createDataFrame(rows, "host string, url int, delay int, p double, seq int"), "host", "delay", "p", "seq").collect()}
    buckets = scheduling.dispatch_times(spark.createDataFrame(rows, "host string, url int, delay int, p double, seq int"), "host", "delay", "p", "seq")
    own = buckets.select(F.lit(None).cast("string").alias("ip"), "host", "url", F.greatest(F.col("delay") / 10, F.lit(1)).cast("int").alias("delay_s"), "bucket", "seq")
    assert {r.url: r.at for r in scheduling.shared_address_dispatch(own).collect()} == timed


def test_shared_address_never_overlaps(spark):
    rows = [("10.0.0.1", f"h{i % 20}", i, 1, 1, i) for i in range(80)]
    at = sorted(r.at for r in scheduling.shared_address_dispatch(spark.createDataFrame(rows, "ip string, host string, url int, delay_s int, bucket int, seq int")).collect())
    assert len(set(at)) == 80 and at == sorted(at)


def replayed(rows, start=0, ip_step=1):
    """Turns of (ip, host, url, delay_s, bucket, seq) by a queue of ready hosts for each address."""
    groups, out = {}, {}
    for r in sorted(rows, key=lambda r: (-r[4], r[5])):
        groups.setdefault(r[0] or ("alone", r[1]), {}).setdefault(r[1], []).append(r)
    for key, queues in groups.items():
        ready, free = [(start, -q[0][4], host, 0) for host, q in queues.items()], start
        heapq.heapify(ready)
        while ready:
            at, rank, host, k = heapq.heappop(ready)
            if isinstance(key, str) and at < free:
                heapq.heappush(ready, (free, rank, host, k))
                continue
            out[queues[host][k][2]], step = at, max(1, queues[host][k][3])
            free = at + max(step, ip_step)
            if k + 1 < len(queues[host]):
                heapq.heappush(ready, (at + step, -queues[host][k + 1][4], host, k + 1))
    return out


def test_shared_address_is_the_replay_over_several_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", None]), f"h{rng.randrange(7)}", i, rng.randrange(5), rng.randrange(4), rng.randrange(10_000) * 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "ip string, host string, url int, delay_s int, bucket int, seq int")
    for start, ip_step, size in ((0, 1, 20), (100, 3, 20), (0, 1, 5000)):
        assert {r.url: r.at for r in scheduling.shared_address_dispatch(df, start, ip_step, size).collect()} == replayed(rows, start, ip_step)


def test_shared_address_query_dispatches_every_customer(spark):
    sf = "/root/testdata/sf0.01"
    customers = spark.read.parquet(f"{sf}/customer.parquet").collect()
    rows = [(f"10.0.0.{c.c_nationkey % 5}", c.c_nationkey, c.c_custkey, c.c_nationkey % 3 + 1, c.c_custkey % 64, c.c_custkey) for c in customers]
    assert len(rows) > 400 and {r.url: r.at for r in history.shared_address_dispatch(spark, sf).collect()} == replayed(rows)


def test_soft404_fingerprints_whole_bodies(spark, tmp_path):
    rows = [(i, "a", f"the same opening, then page {i}") for i in range(10)] + [(i, "a", f"not{' ' * (i - 9)}found") for i in range(10, 18)] + [(i, "b", "not found") for i in range(20, 27)] + [(i, "b", None) for i in range(30, 40)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.source, r.fp, r.urls) for r in content.soft404_bodies(spark, str(tmp_path)).collect()] == [("a", hashlib.md5(b"not found").hexdigest(), 8)]
    online = content.soft404_bodies_online(spark, str(tmp_path)).collect()
    assert len(online) == len(rows) and [r.doc_id for r in online if r.soft_404] == [17]


def test_page_graphs_grow_with_the_links(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    pages = {r.l_orderkey for r in rows} | {r.l_partkey for r in rows}
    assert len(pages) > 50
    for query in (graph.opic_round_pages, graph.opic_score_pages, graph.pagerank_5_pages):
        assert {r.node for r in query(spark, sf).collect()} == pages
    assert web.drum_classify_links(spark, sf).count() == sum(r.l_orderkey % 5 != 0 for r in rows)
    seen = {r.l_partkey for r in rows if r.l_orderkey % 5 == 0}
    assert web.rediscovery_semi_links(spark, sf).count() == sum(r.l_orderkey % 5 != 0 and r.l_partkey in seen for r in rows)


def test_numbered_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("s"))
    assert sorted((r.number, r.s) for r in scheduling.numbered(rows, ["s"], ranges=8).collect()) == [(i, i) for i in range(1000)]
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 9 > 0, F.col("id")).alias("lead"), "id")
    found = sorted((r.number, r.lead, r.id) for r in scheduling.numbered(hot, ["lead", "id"], rows_per_range=100).collect())
    wanted = sorted(((r.lead, r.id) for r in hot.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == [(i, *r) for i, r in enumerate(wanted)]
    assert scheduling.numbered(hot.where("false"), ["lead"]).count() == 0


def test_filter_figures(spark):
    keys = spark.range(20_000).select(F.col("id").alias("k")).union(spark.createDataFrame([(None,), (5,)], "k long"))
    for kind, bits in (("bloom", 12), ("ribbon", 9)):
        got = dedup.filter_figures(keys, "k", kind).head()
        assert got["keys"] == 20_000 and got.bits_per_url < bits and got.false_negatives == 0 and got.false_positive_rate < 0.03
    assert dedup.filter_figures(keys.where("false"), "k").head().false_positive_rate == 0


def test_promotion_and_due(spark):
    urls = spark.createDataFrame([(0, 1, 0.2, 0), (500, 1, 0.2, 5), (0, 4, 0.2, 0), (0, 3, 0.2, 0)], "enqueued int, status int, priority double, next_due int")
    assert [r.priority for r in scheduling.promote_aged(urls, F.lit(600)).collect()] == [1.0, 0.2, 0.2, 0.2]
    assert scheduling.due_urls(urls, F.lit(1), []).count() == 2 and scheduling.due_cold(urls, F.lit(9)).count() == 1


def test_constant_failure_ends_gone(spark):
    rows = spark.createDataFrame([(1, i, 100 + i, 503) for i in range(8)] + [(2, 0, 5, 410), (3, 0, 5, 200), (3, 1, 9, 304)], "url int, seq int, at int, status int")
    full = rows.select("url", "seq", "at", "status", (F.col("status") == 304).alias("not_modified"), F.lit(False).alias("redirect"), F.lit(False).alias("retryable"), F.lit(7).alias("fp"), F.lit(0).alias("sim"))
    got = {r.url: r for r in outcomes.fold(full, ["url"]).collect()}
    assert (got[1].status, got[1].retry_count, got[1].error_count, got[1].crawl_count) == (6, 5, 5, 0)
    assert got[2].status == 6 and got[2].error_count == 1
    assert (got[3].status, got[3].crawl_count, got[3].nochange_streak, got[3].next_due) == (4, 2, 1, 177)


def test_http_dates(spark):
    texts = ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994", "soon", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(outcomes.http_hours(F.col("t"))).collect()
    assert rows[0][0] == rows[1][0] == rows[2][0] == 217808 and rows[3][0] is None and rows[4][0] is None


def test_pagerank_adds_up_and_finds_the_hub(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 200)] + [(0, i) for i in range(1, 200)], "src int, dst int")
    rank = {r.node: r.rank for r in importance.pagerank(edges, 8).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == 0


def test_pagerank_rounds_hold_only_pages_that_are_linked_to(spark):
    pairs = [(i, i % 7) for i in range(10, 200)] + [(i, 3) for i in range(10, 60)] + [(0, 1), (1, 2), (2, 0), (3, 0), (3, 5), (11, None), (0, 1)]
    real, sizes = cutter(spark, "pagerank-test"), {}

    def keep(df, name):
        kept = real(df, name)
        sizes[name] = kept.count()
        return kept

    edges = set(pairs)
    nodes, out = {x for e in edges for x in e}, Counter(s for s, _ in edges)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        lost = sum(rank[x] for x in nodes if x is not None and x not in out)
        got = Counter()
        for s, d in edges:
            got[d] += rank[s] / out[s]
        rank = {x: 0.15 / len(nodes) + 0.85 * ((got[x] if x is not None else 0) + lost / len(nodes)) for x in nodes}
    found = importance.pagerank(spark.createDataFrame(pairs, "src int, dst int"), 4, keep=keep).collect()
    assert {r.node: pytest.approx(r.rank, abs=1e-12) for r in found} == rank and len(found) == len(nodes)
    assert [sizes[f"rank-{k}"] for k in range(4)] == [7] * 4 and sizes["between"] == 5


def test_cash_is_kept(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    state = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 4.0, 1.0)], "node int, cash double, history double")
    new, teleport = importance.opic_round(edges, state)
    assert abs(new.agg(F.sum("cash")).head()[0] + teleport.head()[0] - 7.0) < 1e-9


def test_soft_404_and_suspects(spark):
    pages = spark.createDataFrame([("h", "t", i % 9) for i in range(30)] + [("h", "u", i % 3) for i in range(30)], "host string, fp string, k int")
    assert [(r.fp, r.urls) for r in admission.soft_404(pages, "host", "fp", "k").collect()] == [("t", 9)]
    farm = [("cal", f"http://c/20{y}/{m:02d}/") for y in (31, 32) for m in range(1, 13)] + [("ok", f"http://o/a/{i}") for i in range(40)] + [("ses", f"http://s/p{i}?sid=abc{i:012d}") for i in range(40)]
    assert [r.host for r in admission.trap_suspects(spark.createDataFrame(farm, "host string, url string"), "host", "url", F.lit(494_520)).collect()] == ["cal"]


def test_machine_loss_moves_only_its_partitions(spark):
    parts = spark.range(300).select(F.col("id").alias("partition_id"))
    machines = spark.createDataFrame([(i, 1.0) for i in range(6)], "machine_id long, weight double")
    before = {r.partition_id: r.machine_id for r in placement.preferences(parts, machines, 0).collect()}
    after = {r.partition_id: r.machine_id for r in placement.preferences(parts, machines.where("machine_id <> 2"), 0).collect()}
    assert all(after[p] == m for p, m in before.items() if m != 2)


def test_replica_drops_late_entries(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string")
    tail = spark.createDataFrame([(1, 5, "put", "x"), (2, 6, "del", ""), (3, 7, "put", "y"), (4, 2, "put", "late")], "key int, lsn int, op string, v string")
    assert sorted(map(tuple, placement.replica(snap, tail, "key", applied=3).collect())) == [(1, "x"), (3, "y")]


def test_scaling_rests_after_action(spark):
    loads = [50, 50, 50, 50, 50, 1, 1, 1, 1]
    ticks = F.array(*[F.struct(F.lit(i).alias("tick"), F.lit(x).alias("load")) for i, x in enumerate(loads)])
    rule = Elasticity(high_water=10, low_water=5, max_partitions=3, breaches=2, cooldown=1)
    got = spark.range(1).select(placement.scaling(ticks, rule, 1).alias("x")).head().x
    assert [r.decision for r in got] == ["hold", "up", "hold", "hold", "up", "hold", "hold", "down", "hold"]


def test_polite_curve(spark):
    hosts = spark.createDataFrame([(20,), (5,), (40,), (10,)], "crawl_delay int")
    assert {r.k: r.rate for r in costs.polite_curve(hosts).collect()} == {1: 2.0, 4: 3.75}
    assert costs.human_bytes(1.25e11) == "125.00 GB" and "a" in costs.report("t", [("a", "1")])


def test_handoff_needs_a_matching_ack(spark):
    ship = spark.createDataFrame([(1, 7), (2, 8)], "owner int, checksum long")
    acks = spark.createDataFrame([(1, 3, 7, True), (2, 3, 9, True)], "dest int, epoch int, checksum long, committed boolean")
    assert [r.owner for r in placement.handoff(ship, acks, 3).collect()] == [2]


@pytest.mark.parametrize("partitions", [4])
def test_mean_backlog(spark, partitions):
    assert placement.mean_backlog(spark.createDataFrame([(1, 9), (2, 4)], "p int, depth int"), partitions).head()[0] == 3


def test_partition_map_edits_move_forward():
    from crawlscape.operators.control import PartitionMap

    m = PartitionMap().set_machines((3, 1, 2), replicas=1).add_partition().add_partition()
    assert m.partitions == 3 and m.epoch == 4 and len(m.placement(2)) == 2
    pinned = m.pin(99, 2)
    assert pinned.owner(99) == 2 and pinned.remove_partition().owner(99) in (0, 1)
    assert m.set_health(1, "healthy") is m and m.set_health(1, "failed").epoch == m.epoch + 1
    primary = m.placement(0)[0]
    assert primary not in m.fail_machine(primary).placement(0) and m.fail_machine(77) is m
    assert pinned.newer(m) is pinned and m.newer(pinned) is pinned and PartitionMap().remove_partition().partitions == 1
    with pytest.raises(ValueError):
        m.pin(1, 9)


def test_unseen_equals_the_anti_join(spark):
    """Hot, repeated and null keys; columns named like the operator's own."""
    from crawlscape.operators import dedup

    seen = spark.range(0, 3000, 3).selectExpr("id as k").union(spark.sql("select cast(null as bigint)"))
    rows = spark.range(4000).selectExpr("if(id % 3 = 1, 7, if(id % 50 = 0, null, id)) as k", "id % 2 as bucket", "'x' as blob")
    wanted = rows.join(seen.distinct(), "k", "left_anti")
    for kind in ("bloom", "ribbon"):
        got = dedup.unseen(rows, seen, "k", kind)
        assert got.columns == rows.columns and got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
    assert dedup.unseen(rows.limit(0), seen, "k").count() == 0 and dedup.unseen(rows, seen.limit(0), "k").count() == 4000


def test_folds_keep_one_state(spark):
    """A host with very many outcomes, a null host and an empty table; the fold of a short array says the same."""
    from pyspark.sql import functions as F

    from crawlscape.functions import politeness
    from crawlscape.operators import outcomes

    rows = spark.range(30_000).selectExpr("if(id % 10 < 7, 1, if(id % 10 = 7, null, id % 40)) as host", "id as at", "id as seq", "cast(if(hash(id) % 5 = 0, 503, 200) as bigint) as status", "if(id % 100 = 0, 5000, 0L) as retry_after", "pmod(hash(id, 1), 900) as latency", "400L as delay")
    got = {r.host: tuple(r)[1:] for r in outcomes.fold_rates(rows, "host").collect()}
    event = F.struct("at", "seq", "status", "retry_after", F.col("latency").cast("long").alias("latency"))
    short = rows.groupBy("host").agg(F.sort_array(F.collect_list(event)).alias("e")).withColumn("s", politeness.fold_outcomes(F.col("e"), F.lit(400).cast("long")))
    assert got == {r.host: tuple(r.s) for r in short.select("host", "s").collect()} and None in got
    assert outcomes.fold_rates(rows.limit(0), "host").count() == 0
