"""Queries over links: admission, budgets, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import importance as I
from ..operators import admission, importance
from .adapters import LINKS, links, table


def star_indegree(spark, sf):
    return admission.cross_host_indegree(links(spark, sf), "src_host", "dst_host")


def star_budget(spark, sf):
    found = admission.cross_host_indegree(links(spark, sf), "src_host", "dst_host")
    return found.select("dst_host", I.host_budget(F.col("indegree")).alias("budget"))


def admit_budget(spark, sf):
    """Links as discoveries of page dst on its host, in sequence, with depth cap 5 and the running budget."""
    found = links(spark, sf).select(F.col("dst_host").alias("host"), F.col("dst").alias("url"), "src_host", "depth", "seq").withColumn("trapped", F.col("url") % 97 == 0)
    return admission.admit(found, F.lit(5)).select("host", "url", "seq", "url_count", "url_budget", F.col("status").cast("long").alias("status"))


def opic_credit(spark, sf):
    weighted = links(spark, sf).withColumn("w", (F.col("seq") % 5 - 1).cast("double"))
    return importance.credit(weighted, "dst", "w").select("dst", F.round("cash", 6).alias("cash"))


def _state(spark, sf):
    edges = links(spark, sf).select(F.col("src_host").alias("src"), F.col("dst_host").alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return edges, nodes.select("node", F.lit(1.0).alias("cash"), (F.col("node") % 3).cast("double").alias("history"))


def opic_round(spark, sf):
    edges, state = _state(spark, sf)
    new, _ = importance.opic_round(edges, state)
    return new.select("node", F.round("cash", 6).alias("cash"), F.round("history", 6).alias("history"))


def opic_score(spark, sf):
    edges, state = _state(spark, sf)
    new, teleport = importance.opic_round(edges, state)
    return importance.scores(new, teleport).select("node", F.round("score", 6).alias("score"))


def pagerank_5(spark, sf):
    edges, _ = _state(spark, sf)
    return importance.pagerank(edges, 5).select("node", F.round("rank", 9).alias("rank"))


def _page_state(spark, sf):
    """Links between pages, from orders to parts, and a state for every page; a part that is no order has no out-links."""
    edges = links(spark, sf).select("src", "dst")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return edges, nodes.select("node", F.lit(1.0).alias("cash"), (F.col("node") % 3).cast("double").alias("history"))


def opic_round_pages(spark, sf):
    new, _ = importance.opic_round(*_page_state(spark, sf))
    return new.select("node", F.round("cash", 6).alias("cash"), F.round("history", 6).alias("history"))


def opic_score_pages(spark, sf):
    new, teleport = importance.opic_round(*_page_state(spark, sf))
    return importance.scores(new, teleport).select("node", F.round("score", 6).alias("score"))


def pagerank_5_pages(spark, sf):
    """Ranks of all pages over all links, in units of the mean rank."""
    rank = importance.pagerank(_page_state(spark, sf)[0], 5)
    n = rank.agg(F.count("*").alias("n"))
    return rank.join(F.broadcast(n)).select("node", F.round(F.col("rank") * F.col("n"), 6).alias("rank"))


def blend_priority(spark, sf):
    """Documents as pages: labels are imported ranks and trap flags, sources hosts with a score."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("url"), F.col("source").alias("host"), (F.col("n_chars") / 1000.0).alias("opic"), (F.col("doc_id") % 6).cast("int").alias("depth"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("url"), F.col("quality").cast("double").alias("page_rank"), "toxic")
    flagged = docs.join(labels.select("url", "toxic"), "url", "left").withColumn("flagged", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    hosts = docs.select("host").distinct().where("host <> 'src1'").withColumn("host_score", F.length("host").cast("double"))
    return importance.priorities(flagged, labels, hosts).select("url", F.round("priority", 9).alias("priority"))


def priority_levels(spark, sf):
    p = F.col("l_discount") + F.col("l_tax") / 10
    return table(spark, sf, "lineitem").groupBy(I.front_bucket(p).cast("long").alias("bucket"), I.quantize(p, 12).cast("long").alias("level")).agg(F.count("*").alias("urls"))


QUERIES = {f.__name__: f for f in (star_indegree, star_budget, admit_budget, opic_credit, opic_round, opic_score, pagerank_5, opic_round_pages, opic_score_pages, pagerank_5_pages, blend_priority, priority_levels)}

_EDGES = f"SELECT src_host AS src, dst_host AS dst FROM ({LINKS})"
_OPIC = f"""e AS ({_EDGES}), s AS (SELECT node, 1.0::DOUBLE AS cash, CAST(node % 3 AS DOUBLE) AS history FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
  d AS (SELECT src, count(*) AS n FROM e GROUP BY 1), v AS (SELECT node, cash, n, history * 0.9998::DOUBLE + cash AS history FROM s LEFT JOIN d ON node = src),
  f AS (SELECT dst, sum((cash - cash * 0.15::DOUBLE) / n) AS cash FROM e JOIN v ON node = src GROUP BY 1),
  t AS (SELECT sum(CASE WHEN n IS NULL THEN cash ELSE cash * 0.15::DOUBLE END) AS teleport FROM v),
  r AS (SELECT coalesce(node, dst) AS node, coalesce(f.cash, 0) AS cash, coalesce(history, 0) AS history FROM v FULL JOIN f ON node = dst)"""


_PAGES = f"SELECT src, dst FROM ({LINKS})"
_OPIC_PAGES = _OPIC.replace(_EDGES, _PAGES)


def _rounds(k: int, edges: str = f"SELECT DISTINCT src, dst FROM ({_EDGES})", out: str = "round(rank, 9)") -> str:
    steps = [f"e AS ({edges})", "nn AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "c AS (SELECT count(*) AS n FROM nn)", "d AS (SELECT src, count(*) AS o FROM e GROUP BY 1)", "r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nn, c)"]
    for i in range(k):
        steps.append(f"r{i + 1} AS (SELECT nn.node, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM nn CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM d)) l LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM e JOIN d USING (src) JOIN r{i} ON node = src GROUP BY 1) g ON g.dst = nn.node)")
    return "WITH " + ",\n".join(steps) + f" SELECT node, {out} AS rank FROM r{k}"


_LEVEL = "l_discount + l_tax / 10"
ORACLE = {
    "star_indegree": f"SELECT dst_host, count(DISTINCT src_host) AS indegree FROM ({LINKS}) WHERE src_host <> dst_host GROUP BY 1",
    "star_budget": f"SELECT dst_host, CAST(least(greatest(64 + 16 * count(DISTINCT src_host), 16), 1048576) AS BIGINT) AS budget FROM ({LINKS}) WHERE src_host <> dst_host GROUP BY 1",
    "admit_budget": f"""WITH a AS (SELECT dst_host AS host, dst AS url, depth, seq, src_host, CASE WHEN src_host <> dst_host AND row_number() OVER (PARTITION BY dst_host, CASE WHEN src_host <> dst_host THEN src_host END ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM ({LINKS})),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY seq) AS indegree, row_number() OVER (PARTITION BY host, url ORDER BY seq) AS k FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) - 1 AS url_count, CAST(least(greatest(64 + 16 * indegree, 16), 1048576) AS BIGINT) AS url_budget FROM b WHERE k = 1)
      SELECT host, url, seq, url_count, url_budget, CAST(CASE WHEN depth > 5 OR url_count >= url_budget OR url % 97 = 0 THEN 8 ELSE 1 END AS BIGINT) AS status FROM c""",
    "opic_credit": f"SELECT dst, round(sum(greatest(CAST(seq % 5 - 1 AS DOUBLE), 0)), 6) AS cash FROM ({LINKS}) GROUP BY 1",
    "opic_round": f"WITH {_OPIC} SELECT node, round(cash, 6) AS cash, round(history, 6) AS history FROM r",
    "opic_score": f"WITH {_OPIC} SELECT node, round(ln(1 + history + cash + teleport / (SELECT count(*) FROM r)), 6) AS score FROM r, t",
    "pagerank_5": _rounds(5),
    "opic_round_pages": f"WITH {_OPIC_PAGES} SELECT node, round(cash, 6) AS cash, round(history, 6) AS history FROM r",
    "opic_score_pages": f"WITH {_OPIC_PAGES} SELECT node, round(ln(1 + history + cash + teleport / (SELECT count(*) FROM r)), 6) AS score FROM r, t",
    "pagerank_5_pages": _rounds(5, f"SELECT DISTINCT src, dst FROM ({LINKS})", "round(rank * (SELECT n FROM c), 6)"),
    "blend_priority": """WITH h AS (SELECT DISTINCT source AS host, CAST(length(source) AS DOUBLE) AS score FROM documents WHERE source <> 'src1'),
      d AS (SELECT doc_id AS url, n_chars / 1000.0::DOUBLE AS opic, doc_id % 6 AS depth, CAST(quality AS DOUBLE) AS pr, toxic, ln(1 + coalesce(score, 0)) AS hs FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN h ON source = host)
      SELECT url, round(CASE WHEN pr IS NOT NULL THEN 0.6::DOUBLE * ln(1 + pr) + 0.25::DOUBLE * opic + 0.15::DOUBLE * hs WHEN hs <> 0 THEN 0.7::DOUBLE * opic + 0.3::DOUBLE * hs ELSE opic END * CASE WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 1 END * pow(0.95::DOUBLE, depth), 9) AS priority FROM d""",
    "priority_levels": f"""SELECT CAST(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 63 ELSE 63 - least(63, floor(-log2(p) * 4)) END AS BIGINT) AS bucket, CAST(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 11 ELSE greatest(0, 11 - floor(-log2(p) * (11 / 16.0::DOUBLE))) END AS BIGINT) AS level, count(*) AS urls FROM (SELECT {_LEVEL} AS p FROM lineitem) GROUP BY 1, 2""",
}
