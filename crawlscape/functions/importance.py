"""Importance of pages: scores, blends, penalties and priority levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Importance, Scheduler


def opic_score(history: Column, cash: Column, floor: Column, p: Importance = Importance()) -> Column:
    return F.log1p(history + cash + floor) / (p.log_norm if p.log_norm > 0 else 1.0)


def compress(x: Column) -> Column:
    return F.when(x > 0, F.log1p(x)).otherwise(F.lit(0.0))


def blend(opic: Column, page_rank: Column, host_score: Column, p: Importance = Importance()) -> Column:
    """Imported scores are compressed first. A null ``page_rank`` is one that was not imported; host score 0 is none."""
    for_page, for_opic, for_host = p.blend_all
    opic_only, host_only = p.blend_host
    host = compress(F.coalesce(host_score, F.lit(0.0)))
    return F.when(page_rank.isNotNull(), for_page * compress(page_rank) + for_opic * opic + for_host * host).when(host != 0, opic_only * opic + host_only * host).otherwise(opic)


def penalised(priority: Column, flagged: Column, depth: Column, p: Importance = Importance()) -> Column:
    return priority * F.when(flagged, p.trap_penalty).otherwise(1.0) * F.pow(F.lit(p.depth_decay), F.greatest(depth, F.lit(0)).cast("double"))


def host_budget(cross_host_links: Column, p: Importance = Importance()) -> Column:
    return F.least(F.greatest(p.budget_base + p.budget_per_link * cross_host_links, F.lit(p.budget_min)), F.lit(p.budget_max)).cast("long")


def front_bucket(priority: Column, s: Scheduler = Scheduler()) -> Column:
    """Level 0 to levels-1, four levels to a halving; truncated, not rounded."""
    level = F.floor(-F.log2(priority) * s.level_scale).cast("int")
    return F.when(priority <= 0, 0).when(priority >= 1, s.levels - 1).otherwise(s.levels - 1 - F.least(F.greatest(level, F.lit(0)), F.lit(s.levels - 1)))


def quantize(priority: Column, levels: int, halvings: float = 16.0) -> Column:
    if levels <= 1:
        return F.lit(0)
    level = F.lit(levels - 1) - F.floor(-F.log2(priority) * ((levels - 1) / halvings)).cast("int")
    return F.when(priority <= 0, 0).when(priority >= 1, levels - 1).otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(levels - 1)))


def crosses(old: Column, new: Column, levels: int) -> Column:
    return quantize(old, levels) != quantize(new, levels)


def retry_backoff(retries: Column, s: Scheduler = Scheduler()) -> Column:
    """Hours: 1, 2, 4, ... up to the recrawl gap."""
    step = F.least(F.greatest(retries, F.lit(1)) - 1, F.lit(30)).cast("int")
    return F.least(F.pow(F.lit(2.0), step).cast("long"), F.lit(s.recrawl_gap).cast("long"))
