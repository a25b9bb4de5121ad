"""Change rates and recrawl intervals as column expressions; rates per hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Freshness


def clamp(x: Column, p: Freshness = Freshness()) -> Column:
    return F.least(F.greatest(x, F.lit(p.min_rate)), F.lit(p.max_rate))


def change_rate(crawls: Column, changes: Column, streak: Column, span: Column, p: Freshness = Freshness()) -> Column:
    """Rate from the smoothed share of unchanged intervals, pulled down by a trailing unchanged streak.

    ``span``: hours between the first and the last crawl. Without an interval: the lowest rate."""
    n = (crawls - 1).cast("double")
    mean = span.cast("double") / n
    log_ratio = lambda good, all_: -F.log((good + p.alpha) / (all_ + 2 * p.alpha))
    long_run = log_ratio(F.greatest(n - changes, F.lit(0.0)), n) / mean
    s = streak.cast("double")
    weight = F.exp(-s / p.half_life)
    blended = weight * long_run + (1 - weight) * log_ratio(s, s) / mean
    recent = F.when(streak > 0, F.least(blended, long_run)).otherwise(long_run)
    return F.when((crawls > 1) & (span > 0), clamp(recent, p)).otherwise(F.lit(p.min_rate))


def _gain(rate: Column, f: Column) -> Column:
    """Freshness gained by crawling at f a page that changes at ``rate``, per unit of f."""
    x = rate / f
    shape = F.when(x < 1e-9, F.lit(0.5)).otherwise((1 - F.exp(-x) - x * F.exp(-x)) / (x * x))
    return F.when((rate > 0) & (f > 0), shape * rate / (f * f)).otherwise(F.lit(0.0))


def _weight(priority: Column) -> Column:
    return F.when(priority > 0, priority.cast("double")).otherwise(F.lit(1.0))


def value_density(priority: Column, rate: Column, p: Freshness = Freshness()) -> Column:
    return _weight(priority) * _gain(clamp(rate, p), F.lit(p.ref_rate))


def funded_rate(priority: Column, rate: Column, tau: Column, p: Freshness = Freshness()) -> Column:
    """Crawl rate at which the weighted gain falls to ``tau``: forty halvings of the rate band in one fold."""
    w, r = _weight(priority), clamp(rate, p)
    at = lambda f: w * _gain(r, f)
    start = F.struct(F.lit(p.min_rate).alias("lo"), F.lit(p.max_rate).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) * 0.5
        more = at(mid) > tau
        return F.struct(F.when(more, mid).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) * 0.5)
    return F.when(at(F.lit(p.max_rate)) >= tau, F.lit(p.max_rate)).when(at(F.lit(p.min_rate)) <= tau, F.lit(p.min_rate)).otherwise(root)


def host_share(crawl_delay: Column, urls: Column) -> Column:
    """Crawls per hour that a host's delay (deciseconds; 0 means a second) leaves to each of its URLs."""
    hours = F.when(crawl_delay > 0, crawl_delay / 36000.0).otherwise(F.lit(1 / 3600))
    return 1 / hours / F.greatest(urls.cast("double"), F.lit(1.0))


def target_interval(priority: Column, rate: Column, tau: Column, share: Column | None = None, p: Freshness = Freshness()) -> Column:
    """Hours until the next crawl: a slow probe where the density is at most ``tau``, else the funded rate."""
    funded = F.when(value_density(priority, rate, p) <= tau, F.lit(p.reprobe_rate)).otherwise(funded_rate(priority, rate, tau, p))
    return 1 / clamp(F.least(funded, share) if share is not None else funded, p)


def next_due(last_crawled: Column, interval: Column, spread_key: Column, now: Column, p: Freshness = Freshness()) -> Column:
    """Hour of the next crawl; URLs of a host are spread by ``spread_key`` (not negative) within the interval."""
    hours = F.greatest(F.round(interval).cast("long"), F.lit(1).cast("long"))
    window = F.least(F.lit(p.spread).cast("long"), hours)
    due = last_crawled + hours + F.when(window > 1, spread_key % window).otherwise(F.lit(0).cast("long"))
    return F.when(due <= now, now + p.min_gap).otherwise(due)


def tau_step(tau: float, scheduled: float, budget: float, gain: float = 0.05) -> float:
    """One tick of the water level: five per cent outside a band of two per cent around the budget."""
    if budget <= 0:
        return tau
    if scheduled > 1.02 * budget:
        tau *= 1 + gain
    elif scheduled < 0.98 * budget:
        tau *= 1 - gain
    return max(tau, 1e-12)
