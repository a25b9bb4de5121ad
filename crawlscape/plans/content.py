"""Queries over documents: bodies, templates, near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import keys as K
from ..operators import admission, dedup
from ..storage import cutter
from .adapters import table

_NORM = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def body_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(C.normalize_body(F.col("text")).cast("binary")).alias("body_md5"))


def content_exact_dups(spark, sf):
    fp = F.md5(C.normalize_body(F.col("text")).cast("binary")).alias("fp")
    return table(spark, sf, "documents").groupBy(fp).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1").select("copies", "first_doc")


def _bodies(spark, sf):
    return table(spark, sf, "documents").select("source", F.md5(C.normalize_body(F.col("text")).cast("binary")).alias("fp"), "doc_id")


def soft404_templates(spark, sf):
    """Whole normalised bodies that a source serves on two pages or more."""
    return admission.soft_404(_bodies(spark, sf), "source", "fp", "doc_id", 2)


def soft404_online(spark, sf):
    """Whether a page's whole normalised body was served before; a page without a body is no template."""
    found = admission.soft_404_online(_bodies(spark, sf), "source", "fp", "doc_id", "doc_id", 2)
    return found.select("doc_id", (F.col("soft_404") & F.col("fp").isNotNull()).alias("soft_404"))


def soft404_bodies(spark, sf):
    """Templates by whole normalised bodies, from eight pages on."""
    return admission.soft_404(_bodies(spark, sf), "source", "fp", "doc_id")


def soft404_bodies_online(spark, sf):
    """Whether a page's whole normalised body is a template by then; a page without a body is none."""
    found = admission.soft_404_online(_bodies(spark, sf), "source", "fp", "doc_id", "doc_id")
    return found.select("doc_id", (F.col("soft_404") & F.col("fp").isNotNull()).alias("soft_404"))


def _md5_hash(token: bytes) -> int:
    from hashlib import md5

    return int(md5(token).hexdigest()[:15], 16)


def simhash_md5(spark, sf):
    """Simhash of 60 bits over md5 token hashes, which both engines can compute."""
    return C.simhash(table(spark, sf, "documents").where("text is not null"), "doc_id", "text", 60, _md5_hash)


def simhash_xx64(spark, sf):
    """The 64-bit simhash over seed-0 hashes that page states store."""
    return C.simhash(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")


def near_dup_pairs(spark, sf):
    """Pairs of pages within three bits; equal simhashes meet through their smallest page."""
    return C.near_pairs(simhash_md5(spark, sf), "doc_id", "simhash", width=60).select("a", "b", F.col("distance").cast("long").alias("distance"))


def change_kinds(spark, sf):
    """Every document against the one before it in its source, as two captures of one page."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("fp"))
    sims = simhash_md5(spark, sf)
    from pyspark.sql import Window

    rows = docs.join(sims, "doc_id")
    turn = Window.partitionBy("source").orderBy("doc_id")
    old, sim = F.lag("fp").over(turn), F.lag("simhash").over(turn)
    return rows.withColumn("old", old).withColumn("old_sim", sim).where("old is not null").select("source", C.change_kind(F.col("old"), F.col("fp"), F.col("old_sim"), F.col("simhash")).alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


def url_keys(spark, sf):
    """128-bit keys of pages and their unsigned order."""
    from ..functions.urls import canonical_url, group_of

    pages = table(spark, sf, "pages").select("page_id", canonical_url(F.col("url")).alias("url"))
    return pages.select("page_id", K.host_key(group_of(F.col("url"))).alias("host_key"), K.path_key(F.col("url")).alias("path_key")).orderBy(K.unsigned(F.col("host_key")), K.unsigned(F.col("path_key")))


def bloom_seen_filter(spark, sf):
    """Filters of all page keys and what they say of the keys themselves and of keys that no page has."""
    keys = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k")).distinct()
    buckets = dedup.buckets_for(keys)
    filters = cutter(spark, "seen")(dedup.build_filters(keys, "k", buckets), "filters")  # read twice
    probes = keys.select("k", F.lit(True).alias("present")).union(keys.select(F.col("k") + 1_000_000_007, F.lit(False)))
    hit = dedup.probe_filters(probes, "k", filters, buckets)
    size = filters.agg((F.sum(F.col("bits_per_key") * F.col("keys")) / F.sum("keys")).alias("bits_per_url"))
    return hit.groupBy("present").agg(F.count("*").alias("keys"), F.count_if("maybe_seen").alias("hits")).join(F.broadcast(size))


def ribbon_seen_filter(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    buckets = dedup.buckets_for(keys)
    filters = cutter(spark, "seen")(dedup.build_filters(keys, "k", buckets, "ribbon"), "filters")  # read twice
    probes = keys.select("k", F.lit(True).alias("present")).union(keys.select(F.col("k") + 1_000_000_007, F.lit(False)))
    hit = dedup.probe_filters(probes, "k", filters, buckets)
    size = filters.agg((F.sum(F.col("bits_per_key") * F.col("keys")) / F.sum("keys")).alias("bits_per_url"))
    return hit.groupBy("present").agg(F.count("*").alias("keys"), F.count_if("maybe_seen").alias("hits")).join(F.broadcast(size))


def _unseen_customers(spark, sf, kind):
    """Customers without a pending order: new pages behind a filter of the seen ones."""
    seen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.unseen(table(spark, sf, "customer").select("c_custkey", "c_name"), seen, "c_custkey", kind)


def bloom_prefilter_antijoin(spark, sf):
    return _unseen_customers(spark, sf, "bloom")


def ribbon_prefilter_antijoin(spark, sf):
    return _unseen_customers(spark, sf, "ribbon")


QUERIES = {f.__name__: f for f in (body_normalize, content_exact_dups, soft404_templates, soft404_online, soft404_bodies, soft404_bodies_online, simhash_md5, simhash_xx64, near_dup_pairs, change_kinds, url_keys, bloom_seen_filter, ribbon_seen_filter, bloom_prefilter_antijoin, ribbon_prefilter_antijoin)}

_SIM = f"""SELECT d.doc_id, coalesce(s, 0) AS simhash FROM documents d LEFT JOIN (
  SELECT doc_id, {' + '.join(f'CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {1 << b}::BIGINT ELSE 0 END' for b in range(60))} AS s
  FROM (SELECT doc_id, n, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h FROM
    (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS t FROM documents) GROUP BY ALL))
  GROUP BY doc_id) x ON d.doc_id = x.doc_id WHERE d.text IS NOT NULL"""
_UNSEEN = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
ORACLE = {
    "bloom_prefilter_antijoin": _UNSEEN,
    "ribbon_prefilter_antijoin": _UNSEEN,
    "body_normalize": f"SELECT doc_id, md5({_NORM}) AS body_md5 FROM documents",
    "content_exact_dups": f"SELECT count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY md5({_NORM}) HAVING count(*) > 1",
    "soft404_templates": f"SELECT source, md5({_NORM}) AS fp, count(DISTINCT doc_id) AS urls FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2",
    "soft404_online": f"SELECT doc_id, text IS NOT NULL AND dense_rank() OVER (PARTITION BY source, md5({_NORM}) ORDER BY doc_id) >= 2 AS soft_404 FROM documents",
    "soft404_bodies": f"SELECT source, md5({_NORM}) AS fp, count(DISTINCT doc_id) AS urls FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= 8",
    "soft404_bodies_online": f"SELECT doc_id, text IS NOT NULL AND dense_rank() OVER (PARTITION BY source, md5({_NORM}) ORDER BY doc_id) >= 8 AS soft_404 FROM documents",
    "simhash_md5": _SIM,
    "near_dup_pairs": f"""WITH s AS ({_SIM}), p AS (SELECT simhash, min(doc_id) AS k FROM s WHERE simhash <> 0 GROUP BY 1)
      SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS BIGINT) AS distance FROM p x JOIN p y ON x.k < y.k AND bit_count(xor(x.simhash, y.simhash)) <= 3
      UNION ALL SELECT p.k, s.doc_id, 0 FROM s JOIN p ON s.simhash = p.simhash WHERE s.doc_id <> p.k""",
    "change_kinds": f"""WITH s AS ({_SIM}), r AS (SELECT source, md5(text) AS fp, simhash, lag(md5(text)) OVER w AS old, lag(simhash) OVER w AS old_sim FROM documents JOIN s USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY doc_id))
      SELECT source, CASE WHEN fp = old THEN 'none' WHEN bit_count(xor(simhash, old_sim)) <= 3 THEN 'cosmetic' ELSE 'real' END AS kind, count(*) AS n FROM r WHERE old IS NOT NULL GROUP BY ALL""",
}
