"""Sitemaps: gzip or plain, urlset or index, malformed tails keep what stands before them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url

MAX_BYTES, MAX_ENTRIES = 50 * 1024 * 1024, 50_000


def last_modified_hours(text: str | None) -> int | None:
    """Hours of a W3C date; None for anything else and for times before 1970."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(Z|[+-]\d\d:\d\d))?)?)?", (text or "").strip())
    if not m:
        return None
    y, mo, d, h, mi, s, zone = m.groups()
    shift = 0 if zone in (None, "Z") else (int(zone[1:3]) * 60 + int(zone[4:6])) * (1 if zone[0] == "+" else -1)
    try:
        at = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc).timestamp() - 60 * shift
    except ValueError:
        return None
    return int(at // 3600) if at >= 0 else None


def unpack(body: bytes, most: int = MAX_BYTES) -> bytes:
    if body[:2] != b"\x1f\x8b":
        return body[:most]
    out = zlib.decompressobj(31)
    try:
        return out.decompress(body, most)
    except zlib.error:
        return b""


def parse_sitemap(body: bytes | None) -> tuple[bool, list[tuple[str, int | None]]]:
    """(is an index, [(loc, hours or None)]); parsing stops at the first fault or at the entry limit."""
    found: list[tuple[str, int | None]] = []
    path: list[str] = []
    text: dict[str, str] = {}

    def start(name: str, _: dict) -> None:
        path.append(name.rpartition(":")[2].lower())
        if path[1:] in (["url"], ["sitemap"]):
            text.clear()

    def data(chars: str) -> None:
        if len(path) == 3 and path[2] in ("loc", "lastmod"):
            text[path[2]] = text.get(path[2], "") + chars

    def end(_: str) -> None:
        if path[1:] in (["url"], ["sitemap"]) and text.get("loc", "").strip() and len(found) < MAX_ENTRIES:
            found.append((text["loc"].strip(), last_modified_hours(text.get("lastmod"))))
        path.pop()

    roots: list[str] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda n, a: (roots.append(n.rpartition(":")[2].lower()) if not path and not roots else None, start(n, a))
    parser.EndElementHandler, parser.CharacterDataHandler = end, data
    try:
        parser.Parse(unpack(body or b""), True)
    except expat.ExpatError:
        pass  # what was read before a fault counts
    return roots[:1] == ["sitemapindex"], found


def expand(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, is_index, loc, last_mod) of every entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, b in pdf.itertuples(index=False):
                index, entries = parse_sitemap(None if b is None else bytes(b))
                rows += [(k, index, loc, hours) for loc, hours in entries]
            yield pd.DataFrame(rows, columns=["key", "is_index", "loc", "last_mod"]).astype({"last_mod": "Int32"})

    kind = dict(bodies.dtypes)[key]
    return bodies.select(key, F.col(body).cast("binary")).mapInPandas(run, f"key {kind}, is_index boolean, loc string, last_mod int").withColumnRenamed("key", key)


def packed(entries: DataFrame, key: str, entry: str, seq: str, rows: int = 5000, size: int = 8 * 1024 * 1024) -> DataFrame:
    """(key, body): site maps of about ``rows`` entries or ``size`` bytes, well below the protocol's
    limits, as many as a key needs. Entries are dealt to them by the hash of ``seq``."""
    n, held = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(entry)), F.lit(0))).head()
    maps = max(1, -(-n // rows), -(-held // size))
    dealt = entries.withColumn("__map", F.pmod(F.xxhash64(seq), F.lit(maps)))
    body = F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</urlset>"))
    return dealt.groupBy(key, "__map").agg(body.alias("body")).drop("__map")


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return expand(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


def discoveries(entries: DataFrame, now_hours: int) -> DataFrame:
    """Pages of url sets as discoveries: depth 0, seen when last modified, else now."""
    rows = entries.where(~F.col("is_index")).withColumn("url", canonical_url(F.col("loc"))).where("url is not null")
    return rows.select("url", F.lit(0).alias("depth"), F.lit(2).alias("discovery_source"), F.coalesce("last_mod", F.lit(now_hours)).alias("observed_at"))


def child_sitemaps(entries: DataFrame) -> DataFrame:
    return entries.where("is_index").select(canonical_url(F.col("loc")).alias("url")).where("url is not null").distinct()
