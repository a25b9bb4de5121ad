"""Queries over pages: identity, links, dispatch order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traps as T
from ..functions import urls as U
from ..operators import admission, dedup, scheduling
from ..schema import CanonPolicy
from ..sources import pages as P
from .adapters import LINKS, links, table

_HOST = "regexp_extract(url, '^(?:[^/:]*://)?([^/]*)', 1)"
_PATH = "CASE WHEN regexp_extract(url, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) END"
_REST = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '')"
_DENY = ", ".join(f"'{k}'" for k in U.TRACKING)
_QUERY = f"CASE WHEN contains({_REST}, '?') THEN regexp_replace({_REST}, '^[^?]*\\?', '') ELSE '' END"
_KEPT = f"array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT list_contains([{_DENY}], string_split(p, '=')[1]))), '&')"
_CPATH = f"CASE WHEN regexp_extract({_REST}, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract({_REST}, '^[^/?]*([^?]*)', 1) END"
_CANON = f"lower(string_split(url, ':')[1]) || '://' || lower(regexp_extract({_REST}, '^[^/?]*', 0)) || ({_CPATH}) || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"
_COLLAPSED = f"regexp_replace({_CPATH}, '/+', '/', 'g')"
_INDEXED = f"regexp_replace({_COLLAPSED}, '/({'|'.join(f.replace('.', chr(92) + '.') for f in U.INDEX_FILES)})$', '/')"
_FOLDED = f"CASE WHEN length({_INDEXED}) > 1 THEN coalesce(nullif(regexp_replace({_INDEXED}, '/$', ''), ''), '/') ELSE {_INDEXED} END"
_HREFS = "SELECT page_id, url, generate_subscripts(h, 1) - 1 AS position, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)"


def host_path_split(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))


def url_no_fragment(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))


def query_filter_sort(spark, sf):
    q = F.when(F.instr(F.regexp_replace("url", "#.*$", ""), "?") > 0, F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"^[^?]*\?", "")).otherwise("")
    return table(spark, sf, "pages").select("page_id", U.kept_query(q).alias("query"))


def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))


def trailing_fold(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.fold_trailing(U.path_of(F.regexp_replace("url", r"[?#].*$", ""))).alias("path"))


def index_fold(spark, sf):
    path = F.concat(U.path_of(F.regexp_replace("url", r"[?#].*$", "")), F.when(F.col("page_id") % 2 == 0, "/index.html").otherwise(""))
    return table(spark, sf, "pages").select("page_id", U.collapse_slashes(U.fold_index(path)).alias("path"))


def registrable_domains(spark, sf):
    return table(spark, sf, "pages").groupBy(U.group_of(F.col("url")).alias("domain")).agg(F.count("*").alias("urls"), F.count_distinct(U.host_of(F.col("url"))).alias("hosts"))


def policy_canonical(spark, sf):
    """Full canonicalization under folds; the UDF decides on everything."""
    policy = CanonPolicy(fold_trailing=True, fold_index=True, collapse_slash=True)
    return table(spark, sf, "pages").select("page_id", U.canonical_udf(policy)(F.col("url"), F.lit(None).cast("string")).alias("url"))


def link_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(P.hrefs(F.col("html"))).alias("position", "href")).select("page_id", F.col("position").cast("long").alias("position"), "href")


def page_link_dedup(spark, sf):
    """Distinct targets of a page by tokenizer, resolver and canonical form."""
    return P.extract_links(table(spark, sf, "pages"))


def page_links_distinct(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(P.hrefs(F.col("html")))).alias("href"))


def host_outdegree(spark, sf):
    each = table(spark, sf, "pages").select(U.host_of(F.col("url")).alias("host"), F.explode(P.hrefs(F.col("html"))).alias("href"))
    return each.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


def dedup_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("url"))
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def discovery_antijoin(spark, sf):
    """Links of pages to URLs that no page has: the first sighting of each."""
    pages = table(spark, sf, "pages")
    batch = P.extract_links(pages).select(F.col("target").alias("url"), F.struct("page_id", "position").alias("at"))
    found = dedup.first_sightings(batch, pages.select(U.canonical_url(F.col("url")).alias("url")), ["url"], "at")
    return found.select("url", "at.page_id", "at.position")


def _targets(pages):
    return P.extract_links(pages).select(F.col("target").alias("url"))


def drum_classify(spark, sf):
    """Pages as a batch against the targets of all pages' links."""
    pages = table(spark, sf, "pages")
    batch = pages.select(F.col("page_id").alias("seq"), U.canonical_url(F.col("url")).alias("url"))
    return dedup.classify_batch(batch, _targets(pages), ["url"], "seq").select("seq", "url", "unique")


def rediscovery_semi(spark, sf):
    """Links of all pages to hosts that are crawled, by the page that holds them."""
    pages = table(spark, sf, "pages")
    batch = P.extract_links(pages).select("page_id", "position", U.host_of(F.col("target")).alias("host"))
    return dedup.rediscoveries(batch, pages.select(U.host_of(F.col("url")).alias("host")).distinct(), ["host"]).select("page_id", "position", "host")


def _link_split(spark, sf):
    """Links of every fifth page as seen, those of the other pages as the batch."""
    found = links(spark, sf).select("src", F.col("dst").alias("url"), "seq")
    return found.where("src % 5 <> 0"), found.where("src % 5 = 0").select("url")


def drum_classify_links(spark, sf):
    batch, seen = _link_split(spark, sf)
    return dedup.classify_batch(batch, seen, ["url"], "seq").select("seq", "url", "unique")


def rediscovery_semi_links(spark, sf):
    batch, seen = _link_split(spark, sf)
    return dedup.rediscoveries(batch, seen.distinct(), ["url"]).select("seq", "url")


def dispatch_order(spark, sf):
    """What leaves when: one URL of a host at a time, the most important first."""
    pages = table(spark, sf, "pages").select("page_id", "url", U.host_of(F.col("url")).alias("host"))
    first = pages.groupBy("url", "host").agg(F.min("page_id").alias("page_id"))
    ranked = first.withColumn("priority", F.lit(1.0) / (1 + F.col("page_id") % 10)).withColumn("crawl_delay", (F.length("host") % 4 * 10).cast("int"))
    timed = scheduling.dispatch_times(ranked, "host", "crawl_delay", "priority", "page_id")
    return scheduling.in_dispatch_order(timed.select("page_id", "host", "bucket", F.col("rn").cast("long").alias("rn"), "at"), [F.col("host"), F.col("page_id")])


def _synthetic(spark, sf):
    """URLs with calendars, sessions and facets made of line items, a few hosts each."""
    n, k = F.col("l_partkey"), F.col("l_linenumber")
    base = F.concat(F.lit("http://h"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example/"))
    month = F.concat((F.lit(2020) + n % 40).cast("string"), F.lit("/"), (n % 12 + 1).cast("string"), F.lit("/"))
    session = F.concat(F.lit("p?sid=ab"), F.lpad((n * 7919).cast("string"), 12, "0"))
    facets = F.concat(F.lit("list?color="), (n % 9).cast("string"), F.lit("&size="), (n % 5).cast("string"), F.lit("&page="), n.cast("string"), F.when(n % 2 == 0, "&brand=x").otherwise(""))
    url = F.concat(base, F.when(k % 4 == 0, month).when(k % 4 == 1, session).when(k % 4 == 2, facets).otherwise(F.concat(F.lit("a/"), n.cast("string"))))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey") % 20, url.alias("url")).toDF("host", "url").distinct()


NOW_HOURS = 494_424  # 2026-05-28


def trap_violation(spark, sf):
    urls = _synthetic(spark, sf).withColumn("pairs", T.query_pairs(F.col("url")))
    return urls.groupBy("host", T.trap_kind(F.col("url"), F.col("pairs"), F.lit(NOW_HOURS)).alias("kind")).agg(F.count("*").alias("urls"))


def trap_suspects(spark, sf):
    return admission.trap_suspects(_synthetic(spark, sf), "host", "url", F.lit(NOW_HOURS))


def trap_passes(spark, sf):
    urls = _synthetic(spark, sf)
    suspects = admission.trap_suspects(urls, "host", "url", F.lit(NOW_HOURS))
    return admission.passes(urls, "host", "url", suspects, F.lit(NOW_HOURS)).groupBy("host").agg(F.count_if("passes").alias("passed"), F.count("*").alias("urls"))


_SYN = """SELECT DISTINCT l_suppkey % 20 AS host, 'http://h' || (l_suppkey % 20) || '.example/' || CASE l_linenumber % 4
  WHEN 0 THEN (2020 + l_partkey % 40) || '/' || (l_partkey % 12 + 1) || '/'
  WHEN 1 THEN 'p?sid=ab' || substr(lpad(CAST(l_partkey * 7919 AS VARCHAR), 12, '0'), 1, 12)
  WHEN 2 THEN 'list?color=' || (l_partkey % 9) || '&size=' || (l_partkey % 5) || '&page=' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '&brand=x' ELSE '' END
  ELSE 'a/' || l_partkey END AS url FROM lineitem"""
_KIND = f"""SELECT host, url, CASE
  WHEN regexp_matches(url, '/20[0-9][0-9]/[0-9]+/$') AND CAST(regexp_extract(url, '/(20[0-9][0-9])/', 1) AS BIGINT) * 12 + CAST(regexp_extract(url, '/([0-9]+)/$', 1) AS BIGINT) - 1 > 2026 * 12 + 4 + 12 THEN 'calendar'
  WHEN contains(url, '?sid=') THEN 'session' WHEN contains(url, '&brand=') THEN 'faceted' ELSE 'none' END AS kind FROM ({_SYN})"""
_SUSPECT = f"""SELECT host, max(CASE WHEN kind = 'calendar' AND n >= 16 THEN 1 ELSE 0 END) AS calendar, max(CASE WHEN kind = 'faceted' AND n >= 16 THEN 1 ELSE 0 END) AS faceted, max(CASE WHEN kind = 'session' AND n >= 16 THEN 1 ELSE 0 END) AS session
  FROM (SELECT host, kind, count(*) AS n FROM ({_KIND}) WHERE kind <> 'none' GROUP BY ALL) GROUP BY host HAVING max(n) >= 16"""

QUERIES = {f.__name__: f for f in (host_path_split, url_no_fragment, query_filter_sort, canonical_urls, trailing_fold, index_fold, registrable_domains, policy_canonical, link_extract, page_link_dedup, page_links_distinct, host_outdegree, dedup_urls, discovery_antijoin, drum_classify, rediscovery_semi, drum_classify_links, rediscovery_semi_links, dispatch_order, trap_violation, trap_suspects, trap_passes)}

_P = "regexp_replace(url, '[?#].*$', '')"
_PP = f"CASE WHEN regexp_extract({_P}, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract({_P}, '^(?:[^/:]*://)?[^/]*(/.*)$', 1) END"
_TARGETS = f"""WITH t AS (SELECT page_id, min(position) AS first, lower(string_split(url, ':')[1]) || '://' || lower(regexp_extract({_REST}, '^[^/?]*', 0)) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target FROM ({_HREFS}) GROUP BY ALL)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS position, target, 1::INTEGER AS depth FROM t"""
ORACLE = {
    "host_path_split": f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages",
    "url_no_fragment": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages",
    "query_filter_sort": f"SELECT page_id, {_KEPT} AS query FROM pages",
    "canonical_urls": f"SELECT page_id, {_CANON} AS url FROM pages",
    "trailing_fold": f"SELECT page_id, CASE WHEN length(p) > 1 THEN coalesce(nullif(regexp_replace(p, '/$', ''), ''), '/') ELSE p END AS path FROM (SELECT page_id, {_PP} AS p FROM pages)",
    "index_fold": f"SELECT page_id, regexp_replace(regexp_replace(({_PP}) || CASE WHEN page_id % 2 = 0 THEN '/index.html' ELSE '' END, '/index\\.html$', '/'), '/+', '/', 'g') AS path FROM pages",
    "registrable_domains": f"SELECT regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS urls, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1",
    "policy_canonical": f"SELECT page_id, lower(string_split(url, ':')[1]) || '://' || lower(regexp_extract({_REST}, '^[^/?]*', 0)) || ({_FOLDED}) || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END AS url FROM pages",
    "page_link_dedup": _TARGETS,
    "link_extract": f"SELECT page_id, CAST(position AS BIGINT) AS position, href FROM ({_HREFS})",
    "page_links_distinct": f"SELECT DISTINCT page_id, href FROM ({_HREFS})",
    "host_outdegree": f"SELECT {_HOST} AS host, count(*) AS links, count(DISTINCT href) AS targets FROM ({_HREFS}) GROUP BY 1",
    "dedup_urls": f"SELECT {_CANON} AS url, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
    "discovery_antijoin": f"SELECT target AS url, min_by(page_id, (page_id, position)) AS page_id, min_by(position, (page_id, position)) AS position FROM ({_TARGETS}) WHERE target NOT IN (SELECT {_CANON} FROM pages) GROUP BY 1",
    "drum_classify_links": f"WITH b AS (SELECT src, dst AS url, seq FROM ({LINKS})) SELECT seq, url, row_number() OVER (PARTITION BY url ORDER BY seq) = 1 AND url NOT IN (SELECT url FROM b WHERE src % 5 = 0) AS unique FROM b WHERE src % 5 <> 0",
    "rediscovery_semi_links": f"WITH b AS (SELECT src, dst AS url, seq FROM ({LINKS})) SELECT seq, url FROM b WHERE src % 5 <> 0 AND url IN (SELECT url FROM b WHERE src % 5 = 0)",
    "drum_classify": f"WITH b AS (SELECT page_id AS seq, {_CANON} AS url FROM pages) SELECT seq, url, row_number() OVER (PARTITION BY url ORDER BY seq) = 1 AND url NOT IN (SELECT target FROM ({_TARGETS})) AS unique FROM b",
    "rediscovery_semi": f"WITH b AS (SELECT page_id, position, regexp_extract(target, '^[^/:]*://([^/]*)', 1) AS host FROM ({_TARGETS})) SELECT page_id, position, host FROM b WHERE host IN (SELECT {_HOST} FROM pages)",
    "dispatch_order": f"""WITH f AS (SELECT url, {_HOST} AS host, min(page_id) AS page_id FROM pages GROUP BY ALL),
      b AS (SELECT page_id, host, CAST(CASE WHEN page_id % 10 = 0 THEN 63 ELSE 63 - least(63, CAST(floor(-log2(1.0::DOUBLE / (1 + page_id % 10)) * 4) AS INTEGER)) END AS INTEGER) AS bucket, greatest(1, length(host) % 4) AS step FROM f),
      r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY bucket DESC, page_id) AS rn FROM b)
      SELECT page_id, host, bucket, rn, CAST((rn - 1) * step AS BIGINT) AS at FROM r""",
    "trap_violation": f"SELECT host, kind, count(*) AS urls FROM ({_KIND}) GROUP BY ALL",
    "trap_suspects": _SUSPECT,
    "trap_passes": f"SELECT k.host, count(*) FILTER (WHERE NOT ((kind = 'calendar' AND coalesce(calendar, 0) = 1) OR (kind = 'session' AND coalesce(session, 0) = 1) OR (kind = 'faceted' AND coalesce(faceted, 0) = 1))) AS passed, count(*) AS urls FROM ({_KIND}) k LEFT JOIN ({_SUSPECT}) s ON k.host = s.host GROUP BY k.host",
}
