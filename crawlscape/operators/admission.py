"""Admission of discoveries: running budgets, soft-404 templates, trap suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.importance import host_budget
from ..functions.traps import calendar_trap, facet_count, may_be_trap, query_pairs, session_trap, trap_kind
from ..schema import SCHEDULED, TRAPPED, Importance, Traps


SPAN = 1 << 20


def running_sums(df: DataFrame, group: list[str], seq: str, sums: dict[str, str], tie: str | None = None) -> DataFrame:
    """Adds running sums {new column: column} of a group in order of ``seq``, this row included.

    A group of any size is summed in spans of SPAN numbers of ``seq``, which start at the sums of the spans
    before, so that no task holds all rows of a host."""
    keys = [f"__k{i}" for i in range(len(group))]
    # without nulls, so that the window's partitioning also serves the join
    cut = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null")) for k, g in zip(keys, group, strict=True)})
    cut = cut.withColumn("__span", F.coalesce(F.floor(F.col(seq) / SPAN), F.lit(-1)))
    inside = Window.partitionBy(*keys, "__span").orderBy(seq, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    spans = cut.groupBy(*keys, "__span").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*keys, "__span", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))])
    summed = cut.withColumns({out: F.sum(c).over(inside) for out, c in sums.items()}).join(offsets, [*keys, "__span"])
    return summed.withColumns({out: F.col(out) + F.col(f"__o{i}") for i, out in enumerate(sums)}).drop(*keys, "__span", *[f"__o{i}" for i in range(len(sums))])


def running_distinct(df: DataFrame, group: list[str], value: str, seq: str, out: str) -> DataFrame:
    """Adds the number of distinct non-null values of the group so far, this row included."""
    new = F.row_number().over(Window.partitionBy(*group, value).orderBy(seq)) == 1
    flagged = df.withColumn("__new", F.when(new & F.col(value).isNotNull(), 1).otherwise(0))
    return running_sums(flagged, group, seq, {out: "__new"}).drop("__new")


def cross_host_indegree(links: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct other hosts that link to a host; pairs are made distinct first, so that a hot host is
    counted from as many rows as it has linking hosts."""
    pairs = links.where(F.col(src) != F.col(dst)).select(dst, src).distinct()
    return pairs.groupBy(dst).agg(F.count("*").alias("indegree"))


def admit(discoveries: DataFrame, depth_cap: Column | None = None, budget: Column | None = None, p: Importance = Importance()) -> DataFrame:
    """Adds ``status`` to discoveries (host, url, src_host, depth, seq, ``trapped``) in order of ``seq``.

    The first row of a URL is admitted, later ones only count as links. The budget follows
    the host's distinct linking hosts up to this row; the number of URLs before this one
    counts trapped URLs as well."""
    rest = [c for c in discoveries.columns if c not in ("host", "url", "seq")]
    # what is left of a host are its distinct URLs and the distinct hosts that link to it, however many links there are
    urls = discoveries.groupBy("host", "url").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*rest), "seq").alias("__row"))
    sources = discoveries.where("src_host <> host").groupBy("host", "src_host").agg(F.min("seq").alias("seq"))
    none = F.lit(None).cast(urls.schema["__row"].dataType)
    events = urls.select("host", "url", "seq", "__row", F.lit(1).alias("__url"), F.lit(0).alias("__src"))
    events = events.unionByName(sources.select("host", F.lit(None).cast(urls.schema["url"].dataType).alias("url"), "seq", none.alias("__row"), F.lit(0).alias("__url"), F.lit(1).alias("__src")))
    new = running_sums(events, ["host"], "seq", {"url_count": "__url", "indegree": "__src"}, tie="__url").where("__url = 1")
    new = new.select("host", "url", "seq", *[F.col(f"__row.`{c}`").alias(c) for c in rest], "indegree", (F.col("url_count") - 1).cast("long").alias("url_count"))
    allowed = host_budget(F.col("indegree"), p) if budget is None else budget
    counted = new.withColumn("url_budget", allowed)
    cap = F.lit(0) if depth_cap is None else depth_cap
    parked = ((cap > 0) & (F.col("depth") > cap)) | ((F.col("url_budget") > 0) & (F.col("url_count") >= F.col("url_budget"))) | F.col("trapped")
    return counted.withColumn("status", F.when(parked, TRAPPED).otherwise(SCHEDULED))


def soft_404(pages: DataFrame, host: str, fp: str, key: str, least: int = Traps().soft_404) -> DataFrame:
    """Templates: bodies that at least ``least`` distinct pages of a host share."""
    distinct = pages.where(F.col(fp).isNotNull()).select(host, fp, key).distinct()
    return distinct.groupBy(host, fp).agg(F.count("*").alias("urls")).where(F.col("urls") >= least)


def soft_404_online(pages: DataFrame, host: str, fp: str, key: str, seq: str, least: int = Traps().soft_404) -> DataFrame:
    """Adds ``soft_404``: whether the body is a template once this row has been seen."""
    return running_distinct(pages, [host, fp], key, seq, "__n").withColumn("soft_404", F.col("__n") >= least).drop("__n")


def trap_suspects(urls: DataFrame, host: str, url: str, now: Column, p: Traps = Traps()) -> DataFrame:
    """(host, calendar, faceted, session) of hosts with enough distinct trap URLs of one kind; session URLs
    count per page they decorate."""
    pairs = urls.select(host, url).where(may_be_trap(F.col(url))).distinct().withColumn("__pairs", query_pairs(F.col(url)))
    # through a generator, so that the kind isn't worked out once more for the filter
    trapped = F.filter(F.array(trap_kind(F.col(url), F.col("__pairs"), now, p)), lambda k: k != "none")
    kinds = pairs.select(host, url, F.explode(trapped).alias("kind"))
    base = F.when(F.col("kind") == "session", F.substring_index(url, "?", 1)).otherwise("")
    counts = kinds.withColumn("base", base).groupBy(host, "kind", "base").count()
    over = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("count") >= p.flag_threshold), 1).otherwise(0)).alias(kind)
    return counts.groupBy(host).agg(over("calendar"), over("faceted"), over("session")).where("calendar + faceted + session > 0")


def passes(urls: DataFrame, host: str, url: str, suspects: DataFrame, now: Column, p: Traps = Traps()) -> DataFrame:
    """Adds ``passes``: on a suspect host a URL may not bear a signature that the host is suspect for."""
    pairs = F.col("__pairs")
    joined = urls.join(suspects, host, "left").withColumn("__pairs", query_pairs(F.col(url)))
    bad = (F.coalesce("calendar", F.lit(0)) == 1) & calendar_trap(F.col(url), pairs, now, p)
    bad = bad | ((F.coalesce("session", F.lit(0)) == 1) & session_trap(pairs, p)) | ((F.coalesce("faceted", F.lit(0)) == 1) & (facet_count(pairs) >= p.facet_limit))
    return joined.withColumn("passes", ~bad).drop("calendar", "faceted", "session", "__pairs")
