"""Stateful processors for Structured Streaming: discovery intake, outcome folds, recrawl timers, late-data guards.

State lives in the state store of the query (RocksDB), keyed by host or page, and is
never evicted by time: forgetting a seen URL would admit it twice. Deliveries may
repeat; what is emitted for a key depends on its state alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.outcomes import COUNTERS, apply_outcome, new_page
from ..schema import SCHEDULED, TRAPPED, Importance, Scheduler

ADMITTED = "host STRING, url STRING, seq BIGINT, url_count BIGINT, url_budget BIGINT, status INT, depth BIGINT, weight DOUBLE"
SEEN = 0  # status of a rediscovery
PAGE = ", ".join(["url STRING", *(f"{c} BIGINT" for c in COUNTERS)])
DUE = "url STRING, due_at BIGINT"
GUARDED = "key STRING, version BIGINT, value DOUBLE"


class Intake(StatefulProcessor):
    """Discoveries of a host (url, src_host, depth, seq, link_weight): every new URL once, with its admission, and
    with ``rediscovered`` a row of status SEEN for each later link to it."""

    def __init__(self, depth_cap: int = 0, p: Importance = Importance(), rediscovered: bool = False):
        self.depth_cap, self.p, self.rediscovered = depth_cap, p, rediscovered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url STRING", "seq BIGINT")
        self.sources = handle.getMapState("sources", "src STRING", "seq BIGINT")
        self.counts = handle.getValueState("counts", "urls BIGINT, sources BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (host,) = key
        count, linking = self.counts.get() if self.counts.exists() else (0, 0)
        frames = [f for f in rows if len(f)]
        out = []
        if frames:
            p = self.p
            for r in pd.concat(frames).sort_values("seq", kind="stable").itertuples():
                if r.src_host != host and not self.sources.containsKey((r.src_host,)):
                    self.sources.updateValue((r.src_host,), (int(r.seq),))
                    linking += 1
                budget = min(max(p.budget_base + p.budget_per_link * linking, p.budget_min), p.budget_max)
                if self.urls.containsKey((r.url,)):
                    if self.rediscovered:
                        out.append((host, r.url, int(r.seq), count, budget, SEEN, int(r.depth), r.link_weight))
                    continue
                self.urls.updateValue((r.url,), (int(r.seq),))
                parked = (self.depth_cap and r.depth > self.depth_cap) or count >= budget
                out.append((host, r.url, int(r.seq), count, budget, TRAPPED if parked else SCHEDULED, int(r.depth), r.link_weight))
                count += 1
            self.counts.update((count, linking))
        yield pd.DataFrame(out, columns=["host", "url", "seq", "url_count", "url_budget", "status", "depth", "weight"])

    def close(self) -> None:
        pass


class Outcomes(StatefulProcessor):
    """Outcomes of a page: its state after each batch, by the rules of ``operators.outcomes.apply_outcome``. An
    outcome at or below the last number seen is a repeated delivery."""

    def __init__(self, s: Scheduler = Scheduler()):
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", ", ".join(f"{c} BIGINT" for c in (*COUNTERS, "last")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start = new_page() | {"last": -1}
        a = dict(zip(start, self.page.get(), strict=True)) if self.page.exists() else start
        frames = [f for f in rows if len(f)]
        top = a["last"]
        for r in pd.concat(frames).sort_values(["at", "seq"], kind="stable").itertuples() if frames else ():
            if r.seq > a["last"]:
                top = max(top, int(r.seq))
                apply_outcome(a, r, self.s)
        a["last"] = top
        self.page.update(tuple(a.values()))
        yield pd.DataFrame([(key[0], *(a[c] for c in COUNTERS))], columns=["url", *COUNTERS])

    def close(self) -> None:
        pass


class Timers(StatefulProcessor):
    """Pages with a due time (event time): one row when the watermark passes it; a later due time replaces it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wanted = max((int(v) for f in rows if len(f) for v in f["due_ms"]), default=0)
        if wanted:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.due.update((wanted,))
            self.handle.registerTimer(wanted)
        yield pd.DataFrame({"url": pd.Series(dtype="object"), "due_at": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.due.get()[0] if self.due.exists() else 0
        self.due.clear()
        yield pd.DataFrame({"url": [key[0]], "due_at": [at]})

    def close(self) -> None:
        pass


class Guard(StatefulProcessor):
    """Versioned values (version, value) of a key: what is not newer than what was seen is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "version BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else -1
        out = []
        frames = [f for f in rows if len(f)]
        for r in pd.concat(frames).sort_values("version", kind="stable").itertuples() if frames else ():
            if r.version > seen:
                seen = int(r.version)
                out.append((key[0], seen, float(r.value)))
        self.seen.update((seen,))
        yield pd.DataFrame(out, columns=["key", "version", "value"])

    def close(self) -> None:
        pass


def intake(discoveries: DataFrame, depth_cap: int = 0, p: Importance = Importance(), rediscovered: bool = False) -> DataFrame:
    """``discoveries`` has (host, url, src_host, depth, seq) and, where it is known, link_weight."""
    weight = F.coalesce(F.col("link_weight").cast("double"), F.lit(0.0)) if "link_weight" in discoveries.columns else F.lit(0.0)
    rows = discoveries.select("host", "url", "src_host", "depth", "seq", weight.alias("link_weight"))
    return rows.groupBy("host").transformWithStateInPandas(Intake(depth_cap, p, rediscovered), ADMITTED, "Append", "None")


def outcome_updates(outcomes: DataFrame, s: Scheduler = Scheduler()) -> DataFrame:
    """``outcomes`` has (url, status, at, seq) and, where they are known, not_modified, redirect, retryable, fp and sim."""
    known = outcomes.columns
    flags = [(F.coalesce(c, F.lit(False)) if c in known else F.lit(False)).alias(c) for c in ("not_modified", "redirect", "retryable")]
    numbers = [(F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in known else F.lit(0).cast("long")).alias(c) for c in ("status", "at", "seq", "fp", "sim")]
    return outcomes.select("url", *numbers, *flags).groupBy("url").transformWithStateInPandas(Outcomes(s), PAGE, "Update", "None")


def due_timers(pages: DataFrame, event_time: str, delay: str = "0 seconds") -> DataFrame:
    """``pages`` has (url, due_ms, event_time); rows come out as event time passes the due time."""
    return pages.withWatermark(event_time, delay).groupBy("url").transformWithStateInPandas(Timers(), DUE, "Append", "EventTime")


def newer_only(signals: DataFrame) -> DataFrame:
    return signals.select("key", "version", F.col("value").cast("double").alias("value")).groupBy("key").transformWithStateInPandas(Guard(), GUARDED, "Append", "None")
