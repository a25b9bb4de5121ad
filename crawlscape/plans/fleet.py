"""Queries over layout, placement and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import costs, outcomes, placement
from ..schema import Elasticity
from ..sources import dns, layout, robots, sitemaps
from .adapters import CAPTURES, OUTCOMES, captures, table
from .adapters import outcomes as outcome_rows


def _urls(spark, sf):
    return captures(spark, sf).select(F.col("seq"), (F.col("url_id") % 500).alias("host_key"), F.when(F.col("seq") % 10 == 0, 0).otherwise(F.col("hour") - 230_000).alias("next_due"), (F.col("seq") % 9).alias("status"), (F.col("url_id") % 500).alias("h"))


def schedule_wheel(spark, sf):
    wheeled = layout.wheel(_urls(spark, sf))
    return wheeled.groupBy("bucket").agg(F.count("*").alias("urls"), F.min(layout.bucket_start(F.col("bucket"))).alias("opens"))


def due_by_wheel(spark, sf):
    return layout.due_by_wheel(layout.wheel(_urls(spark, sf)), F.lit(20_000)).select("seq", "next_due")


def host_range(spark, sf):
    return layout.host_range(_urls(spark, sf), 100, 120).select("seq", "host_key")


def _parts(spark, sf):
    return _urls(spark, sf).withColumn("partition_id", F.floor(F.col("host_key") / 70).cast("long"))


def manifest_build(spark, sf):
    return layout.manifest(_parts(spark, sf))


def manifest_route(spark, sf):
    """Customers routed to the file whose key range holds them; keys between ranges have none."""
    files = layout.manifest(_parts(spark, sf).where("host_key % 70 < 60"))
    keys = table(spark, sf, "customer").select("c_custkey")
    return placement.route(keys, F.col("c_custkey") % 600, files)


def coverage_gap(spark, sf):
    files = layout.manifest(_parts(spark, sf).where("host_key % 70 < 60 or partition_id > 2"))
    second = files.withColumn("epoch", F.lit(2).cast("long")).withColumn("lo", F.greatest(F.col("lo") - 5, F.lit(0).cast("long")))
    return placement.coverage_breaks(files.unionByName(second), 0, 499)


def due_parts(spark, sf):
    return layout.due_parts(layout.manifest(_parts(spark, sf)), F.lit(3000)).select("partition_id", "due_min")


def split_at_key(spark, sf):
    low, high = layout.split(_urls(spark, sf), 250)
    return low.agg(F.lit("low").alias("side"), F.count("*").alias("urls"), F.max("host_key").alias("edge")).unionByName(high.agg(F.lit("high").alias("side"), F.count("*").alias("urls"), F.min("host_key").alias("edge")))


def merge_disjoint(spark, sf):
    low, high = layout.split(_urls(spark, sf), 250)
    return layout.merge(low, high).groupBy("host_key").agg(F.count("*").alias("urls"))


def extract_hosts(spark, sf):
    out, rest = layout.extract(_urls(spark, sf), table(spark, sf, "nation").select((F.col("n_nationkey") * 20).alias("host_key")))
    return out.agg(F.lit("moved").alias("part"), F.count("*").alias("urls"), F.count_distinct("host_key").alias("hosts")).unionByName(rest.agg(F.lit("kept").alias("part"), F.count("*").alias("urls"), F.count_distinct("host_key").alias("hosts")))


def compact_gone(spark, sf):
    return layout.compact(_urls(spark, sf)).groupBy("status").agg(F.count("*").alias("urls"))


def in_flight_reset(spark, sf):
    return outcomes.reset_in_flight(_urls(spark, sf)).groupBy(F.col("status").cast("long").alias("status")).agg(F.count("*").alias("urls"), F.count_if("recovered").alias("recovered"))


def owner_jump(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"))
    return keys.select("key", K.owner(F.col("key"), 16, {3: 7}).cast("long").alias("owner"))


def moving_hosts(spark, sf):
    hosts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"))
    return placement.moving_hosts(hosts, "key", 0, 8).groupBy(F.col("owner").cast("long").alias("owner")).agg(F.count("*").alias("hosts"))


def rebalance_cost(spark, sf):
    hosts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), (F.col("s_suppkey") % 13 + 1).alias("urls"), (F.col("s_suppkey") % 13 * 25 + 100).alias("bytes"))
    return costs.rebalance_cost(hosts, K.owner(F.col("key"), 16)).withColumn("moved_fraction", F.round("moved_fraction", 9))


def rendezvous_topk(spark, sf):
    parts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("partition_id"))
    machines = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("machine_id"), F.lit(1.0).alias("weight"))
    return placement.preferences(parts, machines, 1).select("partition_id", "machine_id", F.col("rank").cast("long").alias("rank"))


def rendezvous_weighted(spark, sf):
    parts = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("partition_id"))
    machines = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("machine_id"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
    return placement.preferences(parts, machines, 0, weighted=True).groupBy("machine_id").agg(F.count("*").alias("partitions"))


def replica_lww(spark, sf):
    """A snapshot of customers under a log of orders: later numbers win, every eleventh is a delete."""
    snapshot = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit(0.0).alias("value"))
    tail = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("lsn"), F.when(F.col("o_orderkey") % 11 == 0, "del").otherwise("put").alias("op"), F.col("o_totalprice").alias("value"))
    return placement.replica(snapshot, tail, "key", applied=1000)


def epoch_guard(spark, sf):
    signals = table(spark, sf, "orders").select(F.col("o_custkey").alias("host"), F.floor(F.col("o_orderkey") / 100).cast("long").alias("epoch"), F.col("o_orderkey").alias("score"))
    one = signals.groupBy("host", "epoch").agg(F.max("score").alias("score"))
    return placement.newest_epoch(one, "host", "score", seen=20)


def health_islands(spark, sf):
    """Ticks of hosts as heartbeats: an error is a missed beat."""
    beats = outcome_rows(spark, sf).select(F.col("host").alias("partition_id"), F.col("seq").alias("tick"), (F.col("status") != 503).alias("ok"))
    found = placement.health(beats)
    return found.select("partition_id", "tick", F.col("misses").cast("long").alias("misses"), "state", F.col("epoch").cast("long").alias("epoch"))


def elasticity_ticks(spark, sf):
    """Backlog by hour against water marks, scaled one partition at a time."""
    load = outcome_rows(spark, sf).groupBy("at").agg(F.count("*").alias("load"))
    rule = Elasticity(high_water=18, low_water=10, min_partitions=1, max_partitions=6, breaches=2, cooldown=3)
    series = load.agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("tick"), "load"))).alias("t"))
    return series.select(F.explode(placement.scaling(F.col("t"), rule, 2)).alias("x")).select("x.tick", "x.decision", F.col("x.partitions").cast("long").alias("partitions"))


def fleet_projection(spark, sf):
    measured = spark.range(1).select(F.lit(10.0).alias("bits"), F.lit(30.0).alias("bytes"))
    return measured.select(*costs.projection(F.col("bits"), F.col("bytes"), 1e11, 3e7))


def bloom_baseline(spark, sf):
    return spark.range(1).select(*costs.baseline(F.lit(11.0), F.lit(0.01))).select(*[F.round(c, 6).alias(c) for c in ("naive_bits", "optimal_bits", "naive_ratio", "overhead")])


def robots_allowed(spark, sf):
    """Paths of pages against rules of their hosts."""
    from ..functions.urls import host_of, path_of

    pages = table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    body = F.concat(F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/"), (F.length("host") % 10).cast("string"), F.lit("\nDisallow: /*.html$\nCrawl-delay: 1.5\nSitemap: http://"), "host", F.lit("/s.xml\n"))
    hosts = pages.select("host").distinct().withColumn("parsed", robots.robots_rules(body, "crawler/1.0"))
    return pages.join(hosts, "host").select("page_id", robots.allowed(F.col("parsed"), F.col("path")).alias("allowed"), F.col("parsed.crawl_delay").alias("crawl_delay"))


def sitemap_parse(spark, sf):
    """Site maps made of pages' URLs, as many per host as the protocol's limits ask for."""
    from ..functions.urls import host_of

    pages = table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"), F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc><lastmod>2024-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("-02T03:04:05Z</lastmod></url>")).alias("x"))
    bodies = sitemaps.packed(pages, "host", "x", "page_id")
    return sitemaps.expand(bodies, "host", "body").select("host", "loc", F.col("last_mod").cast("long").alias("last_mod"))


def dns_cache(spark, sf):
    """Outcomes as lookups: errors fail, others answer."""
    answers = outcome_rows(spark, sf).select(F.col("host").cast("string").alias("host"), F.col("seq").alias("at"), F.when(F.col("status") != 503, F.concat(F.lit("10.0.0."), (F.col("host") % 250).cast("string"))).alias("ip"), F.col("latency").alias("ttl"))
    return dns.cached(answers, 9_900)


def safe_handoff(spark, sf):
    """Hosts that stay because their destination did not acknowledge: the even destinations did."""
    hosts = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 8).alias("owner"), (F.col("c_custkey") % 8 * 17).alias("checksum"))
    acks = table(spark, sf, "region").select((F.col("r_regionkey") * 2).alias("dest"), F.lit(3).alias("epoch"), (F.col("r_regionkey") * 2 * 17).alias("checksum"), (F.col("r_regionkey") != 2).alias("committed"))
    return placement.handoff(hosts, acks, 3).groupBy("owner").agg(F.count("*").alias("hosts"))


QUERIES = {f.__name__: f for f in (schedule_wheel, due_by_wheel, host_range, manifest_build, manifest_route, coverage_gap, due_parts, split_at_key, merge_disjoint, extract_hosts, compact_gone, in_flight_reset, owner_jump, moving_hosts, rebalance_cost, rendezvous_topk, rendezvous_weighted, replica_lww, epoch_guard, health_islands, elasticity_ticks, fleet_projection, bloom_baseline, robots_allowed, sitemap_parse, dns_cache, safe_handoff)}

_U = f"SELECT seq, url_id % 500 AS host_key, CASE WHEN seq % 10 = 0 THEN 0 ELSE hour - 230000 END AS next_due, seq % 9 AS status FROM ({CAPTURES})"
_B = "CASE WHEN o < 168 THEN o WHEN o < 2328 THEN 168 + (o - 168) // 24 WHEN o < 19608 THEN 258 + (o - 2328) // 720 ELSE 282 END"
_W = f"SELECT *, CAST({_B} AS INTEGER) AS bucket FROM (SELECT *, next_due - (SELECT min(next_due) FROM ({_U}) WHERE next_due <> 0) AS o FROM ({_U}) WHERE next_due <> 0)"
_PARTS = f"SELECT *, host_key // 70 AS partition_id FROM ({_U})"


def _man(where: str = "true", epoch: int = 1) -> str:
    return f"SELECT partition_id, min(host_key) AS lo, max(host_key) AS hi, count(*) AS url_count, count(DISTINCT host_key) AS host_count, min(nullif(next_due, 0)) AS due_min, {epoch}::BIGINT AS epoch FROM ({_PARTS}) WHERE {where} GROUP BY 1"


def jump_owners(keys: str, n: int) -> str:
    return f"""j AS (SELECT key, key::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM ({keys})
      UNION ALL SELECT key, k2, j, CAST(trunc((j + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT key, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE j < {n})),
      o AS (SELECT key, b AS owner FROM j WHERE j >= {n})"""


_M64 = "18446744073709551616"


def _weights(table: str, key: str) -> str:
    """Common tables up to f (p, m, x): the hash weights of each key and region."""
    return f"""a AS (SELECT {key} AS p, r_regionkey AS m, xor((({key}::HUGEINT * 11400714819323198485) % {_M64}), r_regionkey::HUGEINT) AS x FROM {table}, region),
      b AS (SELECT p, m, xor(x, x // 1073741824) AS x FROM a), c AS (SELECT p, m, ((x // 4294967296 * 13787848793156543929 % 4294967296) * 4294967296 + (x % 4294967296) * 13787848793156543929) % {_M64} AS x FROM b),
      d AS (SELECT p, m, xor(x, x // 134217728) AS x FROM c), e AS (SELECT p, m, ((x // 4294967296 * 10723151780598845931 % 4294967296) * 4294967296 + (x % 4294967296) * 10723151780598845931) % {_M64} AS x FROM d),
      f AS (SELECT p, m, xor(x, x // 2147483648) AS x FROM e)"""


_SUP = "SELECT s_suppkey::BIGINT AS key FROM supplier"
ORACLE = {
    "schedule_wheel": f"SELECT bucket, count(*) AS urls, CAST(min(CASE WHEN bucket < 168 THEN bucket WHEN bucket < 258 THEN 168 + (bucket - 168) * 24 WHEN bucket < 282 THEN 2328 + (bucket - 258) * 720 ELSE 19608 END) AS BIGINT) AS opens FROM ({_W}) GROUP BY 1",
    "due_by_wheel": f"SELECT seq, next_due FROM ({_U}) WHERE next_due <> 0 AND next_due <= 20000",
    "host_range": f"SELECT seq, host_key FROM ({_U}) WHERE host_key BETWEEN 100 AND 120",
    "manifest_build": _man(),
    "manifest_route": f"SELECT c_custkey, partition_id FROM customer LEFT JOIN ({_man('host_key % 70 < 60')}) ON c_custkey % 600 BETWEEN lo AND hi",
    "coverage_gap": f"""WITH m AS ({_man('host_key % 70 < 60 OR partition_id > 2')}), a AS (SELECT epoch, lo, hi FROM m UNION ALL SELECT 2, greatest(lo - 5, 0), hi FROM m), b AS (SELECT * FROM a UNION ALL SELECT DISTINCT epoch, 500, 500 FROM a),
      c AS (SELECT epoch, lo, hi, coalesce(max(hi) OVER (PARTITION BY epoch ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS nxt FROM b)
      SELECT epoch, CASE WHEN lo > nxt THEN 'gap' ELSE 'overlap' END AS kind, least(lo, nxt) AS at_lo, greatest(lo, nxt) - 1 AS at_hi FROM c WHERE lo <> nxt QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY lo, hi) = 1""",
    "due_parts": f"SELECT partition_id, due_min FROM ({_man()}) WHERE due_min <= 3000",
    "split_at_key": f"SELECT 'low' AS side, count(*) AS urls, max(host_key) AS edge FROM ({_U}) WHERE host_key < 250 UNION ALL SELECT 'high', count(*), min(host_key) FROM ({_U}) WHERE host_key >= 250",
    "merge_disjoint": f"SELECT host_key, count(*) AS urls FROM ({_U}) GROUP BY 1",
    "extract_hosts": f"SELECT CASE WHEN host_key IN (SELECT n_nationkey * 20 FROM nation) THEN 'moved' ELSE 'kept' END AS part, count(*) AS urls, count(DISTINCT host_key) AS hosts FROM ({_U}) GROUP BY 1",
    "compact_gone": f"SELECT status, count(*) AS urls FROM ({_U}) WHERE status <> 6 GROUP BY 1",
    "in_flight_reset": f"SELECT CASE WHEN status = 3 THEN 1 ELSE status END AS status, count(*) AS urls, count(*) FILTER (WHERE status = 3) AS recovered FROM ({_U}) GROUP BY 1",
    "owner_jump": f"WITH RECURSIVE {jump_owners(_SUP, 16)} SELECT key, CASE WHEN key = 3 THEN 7 ELSE owner END AS owner FROM o",
    "moving_hosts": f"WITH RECURSIVE {jump_owners(_SUP, 8)} SELECT owner, count(*) AS hosts FROM o WHERE owner <> 0 GROUP BY 1",
    "rebalance_cost": f"""WITH RECURSIVE {jump_owners(_SUP, 16)}, h AS (SELECT owner, key % 13 + 1 AS urls, key % 13 * 25 + 100 AS bytes FROM o)
      SELECT count(*) AS source_hosts, CAST(sum(urls) AS BIGINT) AS source_urls, count(*) FILTER (WHERE owner <> 0) AS moved_hosts, CAST(sum(urls) FILTER (WHERE owner <> 0) AS BIGINT) AS moved_urls, CAST(sum(bytes) FILTER (WHERE owner <> 0) AS BIGINT) AS shipped_bytes, count(DISTINCT owner) FILTER (WHERE owner <> 0) AS destinations, round(CAST(sum(bytes) FILTER (WHERE owner <> 0) AS DOUBLE) / sum(bytes), 9) AS moved_fraction FROM h""",
    "rendezvous_topk": f"""WITH {_weights('nation', 'n_nationkey')}
      SELECT p AS partition_id, m AS machine_id, rank FROM (SELECT p, m, row_number() OVER (PARTITION BY p ORDER BY x DESC, m) AS rank FROM f) WHERE rank <= 2""",
    "rendezvous_weighted": f"""WITH {_weights('customer', 'c_custkey')}
      SELECT m AS machine_id, count(*) AS partitions FROM (SELECT m, row_number() OVER (PARTITION BY p ORDER BY CAST(x AS DOUBLE) * (m + 1) DESC, m) AS rank FROM f) WHERE rank = 1 GROUP BY 1""",
    "replica_lww": """WITH a AS (SELECT c_custkey AS key, -1 AS lsn, 'put' AS op, 0.0::DOUBLE AS value FROM customer UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'del' ELSE 'put' END, o_totalprice FROM orders WHERE o_orderkey > 1000)
      SELECT key, value FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) WHERE op = 'put'""",
    "epoch_guard": "SELECT host, epoch, score FROM (SELECT o_custkey AS host, o_orderkey // 100 AS epoch, max(o_orderkey) AS score FROM orders WHERE o_orderkey // 100 > 20 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY host ORDER BY epoch DESC) = 1",
    "health_islands": f"""WITH b AS (SELECT host AS p, seq AS tick, status <> 503 AS ok FROM ({OUTCOMES})), i AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY p ORDER BY tick) AS i FROM b),
      m AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY p, i ORDER BY tick) AS misses FROM i), s AS (SELECT *, CASE WHEN misses = 0 THEN 'healthy' WHEN misses < 3 THEN 'degraded' ELSE 'failed' END AS state FROM m),
      c AS (SELECT *, CASE WHEN coalesce(lag(state) OVER (PARTITION BY p ORDER BY tick), 'healthy') <> state THEN 1 ELSE 0 END AS c FROM s)
      SELECT p AS partition_id, tick, misses, state, CAST(sum(c) OVER (PARTITION BY p ORDER BY tick) AS BIGINT) AS epoch FROM c""",
    "elasticity_ticks": f"""WITH RECURSIVE t AS (SELECT hour AS tick, count(*) AS load, row_number() OVER (ORDER BY hour) AS rn FROM ({OUTCOMES}) GROUP BY 1),
      s AS (SELECT 0::BIGINT AS tick, 0::BIGINT AS rn, 2 AS n, 0 AS high, 0 AS low, 0 AS rest, 'none' AS decision
        UNION ALL SELECT tick, rn, n + CASE decision WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END, CASE WHEN decision = 'hold' THEN h ELSE 0 END, CASE WHEN decision = 'hold' THEN l ELSE 0 END, CASE WHEN decision = 'hold' THEN greatest(rest - 1, 0) ELSE 3 END, decision
        FROM (SELECT *, CASE WHEN h >= 2 AND n < 6 THEN 'up' WHEN l >= 2 AND n > 1 THEN 'down' ELSE 'hold' END AS decision FROM (SELECT t.tick, t.rn, s.n, s.rest, CASE WHEN s.rest = 0 AND t.load > 18 THEN s.high + 1 ELSE 0 END AS h, CASE WHEN s.rest = 0 AND t.load <= 18 AND t.load < 10 THEN s.low + 1 ELSE 0 END AS l FROM s JOIN t ON t.rn = s.rn + 1)))
      SELECT tick, decision, CAST(n AS BIGINT) AS partitions FROM s WHERE rn > 0""",
    "fleet_projection": "SELECT 1e11 / 3e7 AS partitions, 10.0::DOUBLE * 1e11 / 8 AS seen_bytes, 30.0::DOUBLE * 1e11 AS file_bytes, 10.0::DOUBLE * 1e11 / 8 / (1e11 / 3e7) AS seen_bytes_per_partition, 30.0::DOUBLE * 1e11 / (1e11 / 3e7) AS file_bytes_per_partition",
    "bloom_baseline": "SELECT 128.0::DOUBLE AS naive_bits, round(-ln(0.01::DOUBLE) / (ln(2) * ln(2)), 6) AS optimal_bits, round(128 / 11.0::DOUBLE, 6) AS naive_ratio, round(11.0::DOUBLE / (-ln(0.01::DOUBLE) / (ln(2) * ln(2))), 6) AS overhead",
    "robots_allowed": """SELECT page_id, CASE WHEN greatest(d, h) > a THEN false ELSE true END AS allowed, 1.5::DOUBLE AS crawl_delay FROM (SELECT page_id, CASE WHEN starts_with(path, '/en/') THEN 4 ELSE -1 END AS d, CASE WHEN ends_with(path, '.html') THEN 7 ELSE -1 END AS h, CASE WHEN starts_with(path, '/en/' || (length(host) % 10)) THEN 5 ELSE -1 END AS a
      FROM (SELECT page_id, regexp_extract(url, '^(?:[^/:]*://)?([^/]*)', 1) AS host, CASE WHEN regexp_extract(url, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) END AS path FROM pages))""",
    "sitemap_parse": "SELECT regexp_extract(url, '^(?:[^/:]*://)?([^/]*)', 1) AS host, url AS loc, CAST(floor(epoch(CAST('2024-0' || (page_id % 9 + 1) || '-02 03:04:05' AS TIMESTAMP)) / 3600) AS BIGINT) AS last_mod FROM pages",
    "dns_cache": f"""WITH a AS (SELECT CAST(host AS VARCHAR) AS host, seq AS t, CASE WHEN status <> 503 THEN '10.0.0.' || (host % 250) END AS ip, latency AS ttl FROM ({OUTCOMES})),
      g AS (SELECT host, max(t) FILTER (WHERE ip IS NOT NULL) AS good, max(t) AS last FROM a GROUP BY 1), f AS (SELECT g.host, count(a.t) AS failures FROM g LEFT JOIN a ON a.host = g.host AND a.t > coalesce(g.good, -1) AND a.ip IS NULL GROUP BY 1)
      SELECT g.host, a.ip, g.good + least(greatest(a.ttl, 60), 86400) AS expiry, f.failures > 0 AND g.last + 300 > 9900 AS suppressed, f.failures FROM g JOIN f USING (host) LEFT JOIN a ON a.host = g.host AND a.t = g.good""",
    "safe_handoff": "SELECT c_custkey % 8 AS owner, count(*) AS hosts FROM customer WHERE c_custkey % 8 NOT IN (0, 2, 6) GROUP BY 1",
}
