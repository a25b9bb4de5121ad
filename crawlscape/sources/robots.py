"""robots.txt: parsing into rule arrays, the allow predicate, and its effect on queued pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXCLUDED, FLAG_NO_ROBOTS

MAX_BYTES = 500 * 1024
RULES = "struct<rules:array<struct<pattern:string,regex:string,allow:boolean,length:int>>,crawl_delay:double,sitemaps:array<string>>"


def pattern_regex(pattern: str) -> str | None:
    """Anchored regex of a rule: * is any run, a final $ the end. An empty rule matches nothing; a rule that is
    empty or ends in * before its $ has no end to hold."""
    if not pattern:
        return None
    body = pattern.removesuffix("$")
    ended = pattern.endswith("$") and body and not body.endswith("*")
    parts = [re.sub(r"([^A-Za-z0-9_/])", r"\\\1", p) for p in body.split("*")]
    return "(?s)^" + ".*".join(parts) + ("$" if ended else "")


def parse_robots(body: bytes | None, agent: str) -> tuple | None:
    """(rules, delay, sitemaps) of the group with the longest matching agent prefix, else of the first * group;
    None means that everything is allowed."""
    text = (body or b"")[:MAX_BYTES].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    groups: list[dict] = []
    sitemaps: list[str] = []
    heading = False
    for raw in re.split(r"\r?\n", text):
        name, colon, value = raw.partition("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name:
            continue
        if name == "sitemap":
            sitemaps += [value] if value else []
        elif name in ("user-agent", "useragent"):
            if not heading:
                groups.append({"agents": [], "rules": [], "delay": 0.0})
            heading = True
            groups[-1]["agents"].append(value.lower())
        elif name in ("allow", "disallow", "crawl-delay") and groups:
            heading = False
            if name == "crawl-delay":
                if re.fullmatch(r"[0-9]*\.?[0-9]+(?:e[0-9]+)?", value, re.I):
                    groups[-1]["delay"] = float(value)
            else:
                groups[-1]["rules"].append((value, pattern_regex(value), name == "allow", len(value.removesuffix("$").encode())))
    named = [(len(a), -i) for i, g in enumerate(groups) for a in g["agents"] if a != "*" and agent.lower().startswith(a)]
    stars = [i for i, g in enumerate(groups) if "*" in g["agents"]]
    chosen = -max(named)[1] if named else stars[0] if stars else None
    if chosen is None and not sitemaps:
        return None
    group = groups[chosen] if chosen is not None else {"rules": [], "delay": 0.0}
    return [r for r in group["rules"] if r[1] is not None], group["delay"], sitemaps


def robots_rules(body: Column, agent: str) -> Column:
    @F.pandas_udf(RULES)
    def parse(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for b in bodies:
            found = parse_robots(None if b is None else bytes(b), agent) or ([], 0.0, [])
            rows.append(([{"pattern": p, "regex": r, "allow": a, "length": n} for p, r, a, n in found[0]], found[1], found[2]))
        return pd.DataFrame(rows, columns=["rules", "crawl_delay", "sitemaps"])

    return parse(body.cast("binary"))


def allowed(rules: Column, path: Column) -> Column:
    """The longest matching rule decides, an allow among equals wins, no match allows."""
    hits = F.transform(F.filter(rules["rules"], lambda r: F.regexp_like(path, r["regex"])), lambda r: F.struct(r["length"].alias("n"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))


def apply_robots(urls: DataFrame, fetched: DataFrame, agent: str, now_hours: int, host: str = "host", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(urls with their new status, hosts with expiry, flag and delay).

    2xx parses, 4xx allows all and flags the host, anything else allows all and is retried in an hour. Pages
    that are not allowed stay as excluded rows; a crawl delay (deciseconds) only ever rises."""
    ok, missing = F.col("http_status").between(200, 299), F.col("http_status").between(400, 499)
    hosts = fetched.withColumn("parsed", F.when(ok, robots_rules(F.col("body"), agent)))
    asked = F.least(F.floor(F.coalesce(F.col("parsed.crawl_delay"), F.lit(0.0)) * 10), F.lit(65535)).cast("int")
    hosts = hosts.withColumn("crawl_delay", F.greatest("crawl_delay", asked)).withColumn("robots_expiry", F.lit(now_hours) + F.when(ok | missing, 24).otherwise(1))
    hosts = hosts.withColumn("flags", F.when(ok, F.col("flags").bitwiseAND(F.lit(~FLAG_NO_ROBOTS))).when(missing, F.col("flags").bitwiseOR(F.lit(FLAG_NO_ROBOTS))).otherwise(F.col("flags")))
    joined = urls.join(hosts.select(host, "parsed"), host, "left")
    barred = F.col("parsed").isNotNull() & ~allowed(F.col("parsed"), F.col(path))
    return joined.withColumn("status", F.when(barred, EXCLUDED).otherwise(F.col("status"))).drop("parsed"), hosts
