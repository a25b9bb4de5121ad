"""Schemas, enumerations and defaults of the crawl model. Units: hours since the epoch for page times,
seconds for dispatch times, deciseconds for crawl delays. Zero is "unset" unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field

URL_STATE = (
    "host_key BIGINT, path_key BIGINT, status TINYINT, priority FLOAT, depth INT, discovery_source TINYINT, url STRING, "
    "first_seen INT, last_crawled INT, last_changed INT, next_due INT, lambda FLOAT, crawl_count BIGINT, change_count BIGINT, "
    "nochange_streak INT, etag STRING, last_modified INT, content_fp BIGINT, simhash BIGINT, http_status SMALLINT, "
    "redirect_url STRING, retry_count SMALLINT, error_count INT"
)
HOST_STATE = (
    "host_key BIGINT, host STRING, grouping TINYINT, registrable STRING, resolved_ip BINARY, ip_expiry BIGINT, robots_fetched BIGINT, "
    "robots_expiry BIGINT, robots BINARY, crawl_delay INT, host_next_eligible BIGINT, ip_next_eligible BIGINT, url_budget BIGINT, "
    "url_count BIGINT, depth_cap INT, host_score FLOAT, crawl_total BIGINT, error_total BIGINT, avg_latency INT, flags INT"
)
DISCOVERIES = (
    "seq BIGINT, host_key BIGINT, path_key BIGINT, canonical_url STRING, depth INT, discovery_source TINYINT, src_host_key BIGINT, "
    "link_weight FLOAT, anchor_hint TINYINT, observed_at INT"
)
OUTCOMES = (
    "seq BIGINT, host_key BIGINT, path_key BIGINT, http_status INT, fetched_at INT, latency_ms INT, not_modified BOOLEAN, "
    "content_fp BIGINT, simhash BIGINT, content_len BIGINT, etag STRING, last_modified INT, redirect_target STRING, "
    "retryable BOOLEAN, retry_after INT, robots_crawl_delay INT, robots_body BINARY"
)
CAPTURES = "url STRING, host STRING, status STRING, timestamp STRING, digest STRING, redirect STRING, _corrupt_record STRING"
MANIFEST = (
    "partition_id INT, file_ref STRING, host_key_lo BIGINT, host_key_hi BIGINT, url_count BIGINT, host_count BIGINT, due_min INT, "
    "bytes_per_url FLOAT, created_hours INT, epoch INT"
)

# States and kinds as stored.
STATUS = {0: "discovered", 1: "scheduled", 2: "ready", 3: "in_flight", 4: "crawled", 5: "due_recrawl", 6: "gone", 7: "excluded", 8: "trapped"}
SOURCE = {0: "seed", 1: "link", 2: "sitemap", 3: "redirect", 4: "import"}
SCHEDULED, IN_FLIGHT, CRAWLED, DUE_RECRAWL, GONE, EXCLUDED, TRAPPED = 1, 3, 4, 5, 6, 7, 8
FLAG_TRAP, FLAG_NO_ROBOTS, FLAG_DEAD, FLAG_GROUPING = 1, 2, 4, 8


@dataclass(frozen=True)
class Freshness:
    alpha: float = 0.5
    min_rate: float = 1 / 8760
    max_rate: float = 4.0
    half_life: float = 8.0
    ref_rate: float = 1 / 24
    reprobe_rate: float = 1 / 336
    min_gap: int = 1
    spread: int = 24


@dataclass(frozen=True)
class Importance:
    discount: float = 0.9998
    teleport: float = 0.15
    log_norm: float = 1.0
    blend_all: tuple[float, float, float] = (0.6, 0.25, 0.15)
    blend_host: tuple[float, float] = (0.7, 0.3)
    budget_base: int = 64
    budget_per_link: int = 16
    budget_min: int = 16
    budget_max: int = 1 << 20
    trap_penalty: float = 0.1
    depth_decay: float = 0.95
    discovery_share: float = 0.8
    refresh_share: float = 0.2


@dataclass(frozen=True)
class Politeness:
    """Milliseconds."""

    default: int = 1000
    floor: int = 250
    ceiling: int = 300_000
    ip_floor: int = 500
    backoff: float = 2.0
    soft_widen: float = 1.3
    narrow: int = 100
    latency_rise: float = 1.5
    dead_after: int = 3


@dataclass(frozen=True)
class Traps:
    horizon_months: int = 12
    facet_limit: int = 3
    flag_threshold: int = 16
    token_length: int = 12
    soft_404: int = 8


@dataclass(frozen=True)
class Scheduler:
    recrawl_gap: int = 168
    queues_per_thread: int = 3
    age_sweep: int = 32
    age_hours: int = 168
    levels: int = 64
    level_scale: float = 4.0
    wheel_hours: int = 1024
    max_retries: int = 5
    freshness: Freshness = field(default_factory=Freshness)
    importance: Importance = field(default_factory=Importance)
    politeness: Politeness = field(default_factory=Politeness)
    traps: Traps = field(default_factory=Traps)


@dataclass(frozen=True)
class CanonPolicy:
    fold_trailing: bool = False
    fold_index: bool = False
    collapse_slash: bool = False
    fold_case: bool = False
    query_allow: tuple[str, ...] = ()
    query_deny: tuple[str, ...] = ()


@dataclass(frozen=True)
class Elasticity:
    high_water: int = 1000
    low_water: int = 100
    min_partitions: int = 1
    max_partitions: int = 64
    breaches: int = 3
    cooldown: int = 5


@dataclass(frozen=True)
class Resolver:
    """Seconds."""

    min_ttl: int = 60
    max_ttl: int = 86_400
    negative_ttl: int = 300
