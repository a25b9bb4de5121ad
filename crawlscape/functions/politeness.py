"""Rate control of hosts: units, one step of the controller, and its fold over a host's outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STATUS, Politeness


def deci_to_ms(deci: Column) -> Column:
    return deci.cast("long") * 100


def ms_to_deci(ms: Column) -> Column:
    """Saturates at 65535, the widest stored delay."""
    return F.least(F.floor(F.greatest(ms, F.lit(0)) / 100), F.lit(65535)).cast("int")


def step_seconds(ms: Column) -> Column:
    """Whole seconds, at least one."""
    return F.greatest(F.floor(ms / 1000), F.lit(1)).cast("long")


def is_backoff(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def adapt(interval: Column, status: Column, retry_after: Column, latency: Column, average: Column, p: Politeness = Politeness()) -> Column:
    """The next interval in milliseconds, before it is bounded."""
    rising = (average > 0) & (latency > F.floor(average * p.latency_rise))
    widened = F.floor(interval * p.backoff).cast("long")
    return F.when(is_backoff(status), F.greatest(widened, retry_after)).when(rising, F.floor(interval * p.soft_widen).cast("long")).otherwise(F.greatest(interval - p.narrow, F.lit(0).cast("long")))


def bounded(interval: Column, delay: Column, p: Politeness = Politeness()) -> Column:
    low = F.greatest(F.lit(p.floor).cast("long"), delay)
    return F.when(interval < low, low).when(interval > F.greatest(F.lit(p.ceiling).cast("long"), low), F.greatest(F.lit(p.ceiling).cast("long"), low)).otherwise(interval)


def smooth(average: Column, latency: Column) -> Column:
    """Moving average with weight 1/4 in whole milliseconds; the first latency starts it."""
    return F.when(average == 0, F.least(latency, F.lit(65535))).otherwise(F.least(F.floor((average * 3 + latency) / 4), F.lit(65535))).cast("long")


def fold_outcomes(events: Column, delay: Column, p: Politeness = Politeness()) -> Column:
    """struct<interval, average, crawls, errors, streak, dead> after a host's outcomes in order.

    ``events``: array<struct<status, retry_after, latency>> with longs in milliseconds."""
    zero = F.lit(0).cast("long")
    start = F.struct(bounded(F.lit(p.default).cast("long"), delay, p).alias("interval"), zero.alias("average"), zero.alias("crawls"), zero.alias("errors"), zero.alias("streak"), F.lit(False).alias("dead"))

    def step(acc: Column, e: Column) -> Column:
        now = bounded(adapt(acc["interval"], e["status"], e["retry_after"], e["latency"], acc["average"], p), delay, p)
        bad = is_backoff(e["status"])
        streak = F.when(bad & (now >= p.ceiling), F.least(acc["streak"] + 1, F.lit(255).cast("long"))).otherwise(zero)
        one = F.lit(1).cast("long")
        return F.struct(now.alias("interval"), smooth(acc["average"], e["latency"]).alias("average"), (acc["crawls"] + F.when(e["status"] > 0, one).otherwise(zero)).alias("crawls"), (acc["errors"] + F.when(bad, one).otherwise(zero)).alias("errors"), streak.alias("streak"), (acc["dead"] | (streak >= p.dead_after)).alias("dead"))

    return F.aggregate(events, start, step)


def apply_rate(a: dict, e, p: Politeness = Politeness()) -> None:
    """The step of ``fold_outcomes`` on plain numbers, for outcomes that pass one by one; an interval of 0 has not begun."""
    low = max(p.floor, e.delay)
    high = max(p.ceiling, low)
    before = a["interval"] or min(max(p.default, low), high)
    bad = e.status == 429 or 500 <= e.status <= 599
    if bad:
        after = max(math.floor(before * p.backoff), e.retry_after)
    elif a["average"] > 0 and e.latency > math.floor(a["average"] * p.latency_rise):
        after = math.floor(before * p.soft_widen)
    else:
        after = max(before - p.narrow, 0)
    after = min(max(after, low), high)
    a["average"] = min(e.latency if a["average"] == 0 else (a["average"] * 3 + e.latency) // 4, 65535)
    a["streak"] = min(a["streak"] + 1, 255) if bad and after >= p.ceiling else 0
    a["dead"] = a["dead"] or a["streak"] >= p.dead_after
    a["interval"], a["crawls"], a["errors"] = after, a["crawls"] + (e.status > 0), a["errors"] + bad


def status_name(status: Column) -> Column:
    """The state's name, or status(n) for a number without one."""
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, status.cast("int")), F.concat(F.lit("status("), status.cast("string"), F.lit(")")))
