"""Queries over captures and outcomes: change rates, recrawl times, rate control, page states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import freshness as R
from ..functions import importance as I
from ..functions import politeness as P
from ..operators import costs, outcomes, scheduling
from .adapters import CAPTURES, OUTCOMES, captures, hours, table
from .adapters import outcomes as outcome_rows

NOW = 275_000
TAU = 0.02


def change_stats(spark, sf):
    found = outcomes.change_stats(captures(spark, sf), ["url_id"], "hour", ["hour", "seq"], "digest")
    return found.select("url_id", *[F.col(c).cast("long").alias(c) for c in ("crawls", "changes", "streak", "first_seen", "last_crawled")])


def change_history(spark, sf):
    return outcomes.change_history(captures(spark, sf), ["url_id"], ["hour", "seq"], "digest").select("url_id", "seq", F.col("changed").cast("long").alias("changed"))


def _rates(spark, sf):
    s = change_stats(spark, sf)
    weight = captures(spark, sf).groupBy("url_id").agg(F.max("importance").alias("priority"))
    rate = R.change_rate(F.col("crawls"), F.col("changes"), F.col("streak"), F.col("last_crawled") - F.col("first_seen"))
    return s.join(weight, "url_id").withColumn("rate", rate)


def lambda_estimate(spark, sf):
    return _rates(spark, sf).select("url_id", F.round("rate", 9).alias("rate"))


def value_density(spark, sf):
    return _rates(spark, sf).select("url_id", F.round(R.value_density(F.col("priority"), F.col("rate")), 6).alias("density"))


def funded_rate(spark, sf):
    return _rates(spark, sf).select("url_id", F.round(R.funded_rate(F.col("priority"), F.col("rate"), F.lit(TAU)), 9).alias("funded"))


def _intervals(spark, sf):
    share = R.host_share(F.col("url_id") % 40, F.lit(1000))
    return _rates(spark, sf).withColumn("interval", R.target_interval(F.col("priority"), F.col("rate"), F.lit(TAU), share))


def target_interval(spark, sf):
    return _intervals(spark, sf).select("url_id", F.round("interval", 6).alias("interval"))


def next_due(spark, sf):
    due = R.next_due(F.col("last_crawled"), F.round("interval", 6), F.col("url_id"), F.lit(NOW).cast("long"))
    return _intervals(spark, sf).select("url_id", due.alias("next_due"))


def tau_scheduled_rate(spark, sf):
    """Crawls per hour that the schedule asks for, by which the water level moves."""
    return _intervals(spark, sf).agg(F.round(F.sum(1 / F.col("interval")), 6).alias("scheduled"), F.count("*").alias("urls"))


def allocation_vs_baselines(spark, sf):
    """Weighted freshness of the funded rates against equal rates of the same total."""
    rows = _rates(spark, sf).withColumn("f", R.funded_rate(F.col("priority"), F.col("rate"), F.lit(TAU)))
    mean = rows.agg((F.sum("f") / F.count("*")).alias("mean"))
    fresh = lambda f: F.col("priority") * f / F.col("rate") * (1 - F.exp(-F.col("rate") / f))
    return rows.join(F.broadcast(mean)).agg(F.round(F.sum(fresh(F.col("f"))), 4).alias("funded"), F.round(F.sum(fresh(F.col("mean"))), 4).alias("uniform"))


def retry_backoff(spark, sf):
    retries = (F.col("event_id") % 12).cast("long")
    return table(spark, sf, "events").groupBy(retries.alias("retries")).agg(F.max(I.retry_backoff(retries)).alias("hours"))


def aimd_intervals(spark, sf):
    """Interval, latency average, totals and the dead flag of every host after its outcomes in order."""
    rows = outcome_rows(spark, sf).withColumn("retry_after", F.lit(0)).withColumn("delay", F.col("host") % 5 * 200)
    return outcomes.fold_rates(rows, "host").select("host", "interval", "average", "crawls", "errors", "dead")


def outcome_fold(spark, sf):
    """Counters of every page (a user here) after its outcomes: failures retry and end, bodies change."""
    rows = outcome_rows(spark, sf).select("host", "seq", "at", "status", (F.col("status") == 304).alias("not_modified"), F.lit(False).alias("redirect"), F.lit(False).alias("retryable"), (F.col("fp") % 7 + 1).alias("fp"), F.lit(0).alias("sim"))
    rows = rows.withColumn("sim", F.col("fp") * 1_000_003)
    folded = outcomes.fold(rows, ["host"])
    return folded.select("host", *[F.col(c).cast("long").alias(c) for c in ("status", "retry_count", "error_count", "crawl_count", "change_count", "nochange_streak", "first_seen", "last_crawled", "last_changed", "next_due")])


def status_histogram(spark, sf):
    counts = outcome_rows(spark, sf).groupBy("status").agg(F.count("*").alias("outcomes"), F.count_if(P.is_backoff(F.col("status"))).alias("backoffs"), F.min("at").alias("first_at"))
    return counts


def dead_hosts(spark, sf):
    return aimd_intervals(spark, sf).where("errors >= 10").select("host", "errors")


def due_topk(spark, sf):
    """The fifty captures that have been due longest, with ties by key."""
    urls = captures(spark, sf).select("url_id", "seq", (F.col("hour") + F.col("seq") % 168).alias("next_due"), (F.col("seq") % 9).alias("status"))
    return scheduling.due_urls(urls, F.lit(NOW), [F.col("seq")], limit=50).select("url_id", "seq", "next_due")


def due_cold(spark, sf):
    urls = captures(spark, sf).select("seq", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("hour")).alias("next_due"))
    return scheduling.due_cold(urls, F.lit(240_000))


def due_count_by_status(spark, sf):
    urls = captures(spark, sf).select((F.col("seq") % 9).alias("status"), (F.col("hour") + F.col("seq") % 168).alias("next_due"))
    return urls.groupBy("status").agg(F.count("*").alias("urls"), F.count_if(F.col("next_due") <= NOW).alias("due"), F.min("next_due").alias("earliest"))


def polite_ceiling(spark, sf):
    hosts = table(spark, sf, "supplier").select((F.col("s_suppkey") % 41).cast("int").alias("crawl_delay"))
    return costs.polite_ceiling(hosts).select("hosts", F.round("summed", 6).alias("summed"), F.round("median", 6).alias("median"))


def politeness_curve(spark, sf):
    hosts = table(spark, sf, "supplier").select((F.col("s_suppkey") % 41).cast("int").alias("crawl_delay"))
    return costs.polite_curve(hosts).select("k", F.round("rate", 6).alias("rate"))


def polite_spread(spark, sf):
    """Dispatch seconds where every URL has a step of its own."""
    urls = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("host"), (F.col("c_custkey") % 5 + 1).alias("step"))
    return scheduling.spread(urls, "host", [F.col("c_custkey")], F.col("step")).select("c_custkey", F.col("at").cast("long").alias("at"))


def stream_split(spark, sf):
    """Discovery and refresh at four to one: turns of both streams."""
    d = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("seq"))
    r = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq"))
    return scheduling.split_streams(d, r, "seq").select("seq", "stream", F.round("turn", 6).alias("turn"))


def hourly_outcomes(spark, sf):
    """Outcomes in tumbling hours: the windows that due buckets are."""
    rows = outcome_rows(spark, sf)
    return rows.groupBy("at").agg(F.count("*").alias("outcomes"), F.count_if(F.col("status") == 503).alias("errors"))


def gaps_between_visits(spark, sf):
    rows = outcome_rows(spark, sf)
    turn = Window.partitionBy("host").orderBy("at", "seq")
    return rows.withColumn("gap", F.col("at") - F.lag("at").over(turn)).groupBy("host").agg(F.max("gap").alias("longest"), F.count("gap").alias("gaps"))


def shared_address_dispatch(spark, sf):
    """Hosts behind five addresses take turns."""
    urls = table(spark, sf, "customer").select(F.concat(F.lit("10.0.0."), (F.col("c_nationkey") % 5).cast("string")).alias("ip"), F.col("c_nationkey").alias("host"), F.col("c_custkey").alias("url"), (F.col("c_nationkey") % 3 + 1).alias("delay_s"), (F.col("c_custkey") % 64).alias("bucket"), F.col("c_custkey").alias("seq"))
    return scheduling.shared_address_dispatch(urls)


def capture_hours(spark, sf):
    return table(spark, sf, "orders").groupBy(hours("o_orderdate").alias("hour")).agg(F.count("*").alias("captures"))


QUERIES = {f.__name__: f for f in (change_stats, change_history, lambda_estimate, value_density, funded_rate, target_interval, next_due, tau_scheduled_rate, allocation_vs_baselines, retry_backoff, aimd_intervals, outcome_fold, status_histogram, dead_hosts, due_topk, due_cold, due_count_by_status, polite_ceiling, politeness_curve, polite_spread, stream_split, hourly_outcomes, gaps_between_visits, shared_address_dispatch, capture_hours)}

_HIST = f"SELECT *, CASE WHEN lag(digest) OVER w IS NOT NULL THEN CAST(digest <> lag(digest) OVER w AS BIGINT) END AS changed FROM ({CAPTURES}) WINDOW w AS (PARTITION BY url_id ORDER BY hour, seq)"
_STATS = f"""SELECT url_id, count(*) AS crawls, CAST(sum(coalesce(changed, 0)) AS BIGINT) AS changes, count(*) FILTER (WHERE run = last) - 1 AS streak, min(hour) AS first_seen, max(hour) AS last_crawled
  FROM (SELECT *, max(run) OVER (PARTITION BY url_id) AS last FROM (SELECT *, sum(coalesce(changed, 0)) OVER (PARTITION BY url_id ORDER BY hour, seq) AS run FROM ({_HIST}))) GROUP BY url_id"""
_LO, _HI = "(1::DOUBLE / 8760)", "4.0::DOUBLE"
_RATE = f"""SELECT s.*, priority, CASE WHEN crawls > 1 AND last_crawled > first_seen THEN least(greatest(CASE WHEN streak > 0 THEN least(exp(-streak / 8.0::DOUBLE) * lng + (1 - exp(-streak / 8.0::DOUBLE)) * (-ln((streak + 0.5::DOUBLE) / (streak + 1.0::DOUBLE)) / mean), lng) ELSE lng END, {_LO}), {_HI}) ELSE {_LO} END AS rate
  FROM (SELECT *, (last_crawled - first_seen)::DOUBLE / (crawls - 1) AS mean, -ln((greatest(crawls - 1 - changes, 0) + 0.5::DOUBLE) / (crawls - 1 + 1.0::DOUBLE)) / ((last_crawled - first_seen)::DOUBLE / (crawls - 1)) AS lng FROM ({_STATS})) s
  JOIN (SELECT url_id, max(importance) AS priority FROM ({CAPTURES}) GROUP BY 1) p ON s.url_id = p.url_id"""


def _g(f: str) -> str:
    x = f"(rate / ({f}))"
    return f"(CASE WHEN {x} < 1e-9 THEN 0.5::DOUBLE ELSE (1 - exp(-{x}) - {x} * exp(-{x})) / ({x} * {x}) END * rate / (({f}) * ({f})))"


_W = "(CASE WHEN priority > 0 THEN priority ELSE 1.0::DOUBLE END)"
_FUNDED = f"""WITH RECURSIVE r AS ({_RATE}), b AS (SELECT url_id, priority, rate, {_LO} AS lo, {_HI} AS hi, 0 AS i FROM r
  UNION ALL SELECT url_id, priority, rate, CASE WHEN {_W} * {_g('(lo + hi) * 0.5::DOUBLE')} > {TAU}::DOUBLE THEN (lo + hi) * 0.5::DOUBLE ELSE lo END, CASE WHEN {_W} * {_g('(lo + hi) * 0.5::DOUBLE')} > {TAU}::DOUBLE THEN hi ELSE (lo + hi) * 0.5::DOUBLE END, i + 1 FROM b WHERE i < 40),
  f AS (SELECT r.*, CASE WHEN {_W.replace('priority', 'r.priority')} * {_g(_HI).replace('rate', 'r.rate')} >= {TAU} THEN {_HI} WHEN {_W.replace('priority', 'r.priority')} * {_g(_LO).replace('rate', 'r.rate')} <= {TAU} THEN {_LO} ELSE (b.lo + b.hi) * 0.5::DOUBLE END AS funded FROM r JOIN b ON b.url_id = r.url_id AND b.i = 40),
  t AS (SELECT *, 1 / least(greatest(least(CASE WHEN {_W} * {_g('(1::DOUBLE / 24)')} <= {TAU} THEN 1::DOUBLE / 336 ELSE funded END, 1 / (CASE WHEN url_id % 40 > 0 THEN url_id % 40 / 36000.0::DOUBLE ELSE 1::DOUBLE / 3600 END) / 1000), {_LO}), {_HI}) AS interval FROM f)"""
_AIMD = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY hour, seq) AS rn FROM ({OUTCOMES})),
  s AS (SELECT DISTINCT host, 0::BIGINT AS rn, greatest(1000, host % 5 * 200)::BIGINT AS interval, 0::BIGINT AS average, 0::BIGINT AS crawls, 0::BIGINT AS errors, 0::BIGINT AS streak, false AS dead FROM e
    UNION ALL SELECT host, rn, nxt, CASE WHEN average = 0 THEN least(latency, 65535) ELSE least((average * 3 + latency) // 4, 65535) END, crawls + 1, errors + bad, CASE WHEN bad = 1 AND nxt >= 300000 THEN streak + 1 ELSE 0 END, dead OR (bad = 1 AND nxt >= 300000 AND streak + 1 >= 3)
    FROM (SELECT e.host, e.rn, e.latency, s.average, s.crawls, s.errors, s.streak, s.dead, CASE WHEN e.status = 429 OR e.status BETWEEN 500 AND 599 THEN 1 ELSE 0 END AS bad,
      least(greatest(CASE WHEN e.status = 429 OR e.status BETWEEN 500 AND 599 THEN s.interval * 2 WHEN s.average > 0 AND e.latency > CAST(floor(s.average * 1.5::DOUBLE) AS BIGINT) THEN CAST(floor(s.interval * 1.3::DOUBLE) AS BIGINT) ELSE greatest(s.interval - 100, 0) END, 250, e.host % 5 * 200), 300000)::BIGINT AS nxt
      FROM s JOIN e ON e.host = s.host AND e.rn = s.rn + 1)),
  l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY rn DESC) = 1)"""
_FOLD = f"""WITH RECURSIVE e AS (SELECT host, hour, status, fp % 7 + 1 AS fp, row_number() OVER (PARTITION BY host ORDER BY hour, seq) AS rn FROM ({OUTCOMES})),
  s AS (SELECT DISTINCT host, 0::BIGINT AS rn, 1::BIGINT AS status, 0::BIGINT AS retry_count, 0::BIGINT AS error_count, 0::BIGINT AS crawl_count, 0::BIGINT AS change_count, 0::BIGINT AS nochange_streak, 0::BIGINT AS first_seen, 0::BIGINT AS last_crawled, 0::BIGINT AS last_changed, 0::BIGINT AS next_due, 0::BIGINT AS fp FROM e
    UNION ALL SELECT host, rn, CASE WHEN gone THEN status WHEN bad THEN CASE WHEN retries >= 5 THEN 6 ELSE 1 END ELSE 4 END, CASE WHEN gone THEN retry_count WHEN bad THEN retries ELSE 0 END, CASE WHEN NOT gone AND bad THEN error_count + 1 ELSE error_count END,
      CASE WHEN gone OR bad THEN crawl_count ELSE crawl_count + 1 END, CASE WHEN NOT gone AND real THEN change_count + 1 ELSE change_count END, CASE WHEN gone THEN nochange_streak WHEN real THEN 0 WHEN quiet THEN nochange_streak + 1 ELSE nochange_streak END,
      CASE WHEN NOT gone AND NOT bad AND first_seen = 0 THEN hour ELSE first_seen END, CASE WHEN gone OR bad THEN last_crawled ELSE hour END, CASE WHEN NOT gone AND real THEN hour ELSE last_changed END,
      CASE WHEN gone THEN next_due WHEN bad THEN CASE WHEN retries >= 5 THEN next_due ELSE hour + least(CAST(pow(2, retries - 1) AS BIGINT), 168) END ELSE hour + 168 END, CASE WHEN NOT gone AND body THEN nfp ELSE fp END
    FROM (SELECT *, body AND fp <> 0 AND bit_count(xor(fp * 1000003, nfp * 1000003)) > 3 AND fp <> nfp AS real, (body AND fp <> 0 AND (fp = nfp OR bit_count(xor(fp * 1000003, nfp * 1000003)) <= 3)) OR est = 304 AS quiet
      FROM (SELECT s.host, e.rn, s.status, s.retry_count, s.error_count, s.crawl_count, s.change_count, s.nochange_streak, s.first_seen, s.last_crawled, s.last_changed, s.next_due, s.fp, e.fp AS nfp, e.hour, e.status AS est, s.status = 6 AS gone, e.status BETWEEN 400 AND 599 AS bad, e.status NOT BETWEEN 400 AND 599 AND e.status <> 304 AS body, least(s.retry_count + 1, 5) AS retries FROM s JOIN e ON e.host = s.host AND e.rn = s.rn + 1)))
  SELECT host, status, retry_count, error_count, crawl_count, change_count, nochange_streak, first_seen, last_crawled, last_changed, next_due FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY rn DESC) = 1"""
_DUE = f"SELECT url_id, seq, hour + seq % 168 AS next_due, seq % 9 AS status FROM ({CAPTURES})"
_DELAYS = "SELECT s_suppkey % 41 AS d FROM supplier WHERE s_suppkey % 41 > 0"
ORACLE = {
    "change_stats": _STATS,
    "change_history": f"SELECT url_id, seq, changed FROM ({_HIST})",
    "lambda_estimate": f"SELECT url_id, round(rate, 9) AS rate FROM ({_RATE})",
    "value_density": f"SELECT url_id, round({_W} * {_g('(1::DOUBLE / 24)')}, 6) AS density FROM ({_RATE})",
    "funded_rate": f"{_FUNDED} SELECT url_id, round(funded, 9) AS funded FROM t",
    "target_interval": f"{_FUNDED} SELECT url_id, round(interval, 6) AS interval FROM t",
    "next_due": f"""{_FUNDED} SELECT url_id, CASE WHEN due <= {NOW} THEN {NOW} + 1 ELSE due END AS next_due FROM (SELECT url_id, last_crawled + h + CASE WHEN least(24, h) > 1 THEN url_id % least(24, h) ELSE 0 END AS due FROM (SELECT *, greatest(CAST(round(round(interval, 6)) AS BIGINT), 1) AS h FROM t))""",
    "tau_scheduled_rate": f"{_FUNDED} SELECT round(sum(1 / interval), 6) AS scheduled, count(*) AS urls FROM t",
    "allocation_vs_baselines": f"{_FUNDED}, m AS (SELECT sum(funded) / count(*) AS equal FROM f) SELECT round(sum(priority * funded / rate * (1 - exp(-rate / funded))), 4) AS funded, round(sum(priority * equal / rate * (1 - exp(-rate / equal))), 4) AS uniform FROM f, m",
    "retry_backoff": "SELECT event_id % 12 AS retries, max(least(CAST(pow(2, greatest(event_id % 12, 1) - 1) AS BIGINT), 168)) AS hours FROM events GROUP BY 1",
    "aimd_intervals": f"{_AIMD} SELECT host, interval, average, crawls, errors, dead FROM l",
    "outcome_fold": _FOLD,
    "status_histogram": f"SELECT status, count(*) AS outcomes, count(*) FILTER (WHERE status = 429 OR status BETWEEN 500 AND 599) AS backoffs, min(hour) AS first_at FROM ({OUTCOMES}) GROUP BY 1",
    "dead_hosts": f"SELECT host, count(*) AS errors FROM ({OUTCOMES}) WHERE status = 503 GROUP BY 1 HAVING count(*) >= 10",
    "due_topk": f"SELECT url_id, seq, next_due FROM ({_DUE}) WHERE status NOT IN (3, 6, 7, 8) AND next_due <= {NOW} ORDER BY next_due, seq LIMIT 50",
    "due_cold": f"SELECT seq, next_due FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE hour END AS next_due FROM ({CAPTURES})) WHERE next_due <> 0 AND next_due <= 240000",
    "due_count_by_status": f"SELECT status, count(*) AS urls, count(*) FILTER (WHERE next_due <= {NOW}) AS due, min(next_due) AS earliest FROM ({_DUE}) GROUP BY 1",
    "polite_ceiling": f"SELECT count(*) AS hosts, round(sum(10.0::DOUBLE / d), 6) AS summed, round(10.0::DOUBLE / list_sort(list(d))[count(*) // 2 + 1], 6) AS median FROM ({_DELAYS})",
    "politeness_curve": f"""WITH r AS (SELECT row_number() OVER (ORDER BY d) AS k, sum(10.0::DOUBLE / d) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS rate FROM ({_DELAYS}))
      SELECT k, round(rate, 6) AS rate FROM r WHERE k = (SELECT max(k) FROM r) OR k IN (1, 10, 100, 1000, 10000, 100000)""",
    "polite_spread": "SELECT c_custkey, CAST(coalesce(sum(c_custkey % 5 + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM customer",
    "stream_split": "SELECT o_orderkey AS seq, 'discovery' AS stream, round((row_number() OVER (ORDER BY o_orderkey) - 1) / 0.8::DOUBLE, 6) AS turn FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'refresh', round((row_number() OVER (ORDER BY o_orderkey) - 1) / 0.2::DOUBLE, 6) FROM orders WHERE o_orderstatus = 'F'",
    "hourly_outcomes": f"SELECT hour AS at, count(*) AS outcomes, count(*) FILTER (WHERE status = 503) AS errors FROM ({OUTCOMES}) GROUP BY 1",
    "gaps_between_visits": f"SELECT host, max(gap) AS longest, count(gap) AS gaps FROM (SELECT host, hour - lag(hour) OVER (PARTITION BY host ORDER BY hour, seq) AS gap FROM ({OUTCOMES})) GROUP BY 1",
    "shared_address_dispatch": """SELECT '10.0.0.' || (c_nationkey % 5) AS ip, c_nationkey AS host, c_custkey AS url, CAST(coalesce(sum(c_nationkey % 3 + 1) OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey % 64 DESC, c_nationkey, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM customer""",
    "capture_hours": "SELECT CAST(floor(epoch(o_orderdate) / 3600) AS BIGINT) AS hour, count(*) AS captures FROM orders GROUP BY 1",
}
