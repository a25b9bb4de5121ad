"""Trap signatures of a canonical URL: far-future calendars, session ids, stacked facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Traps

# Query keys of each signature.
FACET_KEYS = ["filter", "facet", "refine", "narrow", "color", "colour", "size", "brand", "price", "price_min", "price_max", "minprice", "maxprice", "pricerange", "sort", "sortby", "order", "orderby", "view", "mode", "layout", "category", "cat", "tag", "tags", "style", "material", "rating", "availability", "instock", "attr", "option"]
SESSION_KEYS = ["sid", "sessionid", "session_id", "sessid", "sess", "jsessionid", "phpsessid", "aspsessionid", "aspxauth", "cfid", "cftoken", "sessiontoken", "session_token", "sessionkey", "bsessionid", "zenid", "oscsid", "ssid"]
DATE_KEYS = ["date", "day", "from", "to", "start", "end", "when"]


def query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of the query, in order; a key may come more than once."""
    query = F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?([^#]*)", 1)).otherwise("")
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))


def high_entropy(v: Column, shortest: int = 12) -> Column:
    """At least two letters and a digit, a token alphabet, few separators; lengths in bytes."""
    count = lambda drop: F.length(F.regexp_replace(v, drop, ""))
    return (F.octet_length(v) >= shortest) & v.rlike(r"^[A-Za-z0-9._%-]+$") & (count("[^A-Za-z]") >= 2) & (count("[^0-9]") >= 1) & (count("[^._%-]") <= F.floor(F.octet_length(v) / 4))


def month_of_hours(hours: Column) -> Column:
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(hours / 24).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("long")


def _plausible(year: Column) -> Column:
    return year.between(1990, 2099)


def _year_month(year: str | Column, month: str | Column) -> Column:
    y, m = year.cast("long"), month.cast("long")
    return F.when(_plausible(y) & m.between(1, 12), y * 12 + m - 1)


def url_month(url: Column, pairs: Column) -> Column:
    """Months since year 0 of a /YYYY/M/ path pair, a year (and month) parameter or a dated value; or null."""
    path = F.regexp_extract(url, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)
    pattern = r"(?:^|/)((?:199[0-9]|20[0-9]{2})/(?:0?[1-9]|1[0-2]))(?=/|$)"
    pair = F.split(F.regexp_extract(path, pattern, 1), "/")
    from_path = F.when(F.size(pair) == 2, _year_month(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))
    value = lambda name: F.get(F.transform(F.filter(pairs, lambda x: x["k"] == name), lambda x: x["v"]), F.lit(0))
    number = lambda c: F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int"))
    year, month = number(value("year")), number(value("month"))
    from_year = F.when(_plausible(year), year.cast("long") * 12 + F.when(month.between(1, 12), month - 1).otherwise(0))
    dated = F.filter(F.transform(F.filter(pairs, lambda x: F.lower(x["k"]).isin(DATE_KEYS)), lambda x: F.regexp_extract(F.trim(x["v"]), r"^((?:199[0-9]|20[0-9]{2})[-/](?:0?[1-9]|1[0-2]))(?:[-/].*)?$", 1)), lambda d: d != "")
    first = F.split(F.get(dated, F.lit(0)), "[-/]")
    return F.coalesce(from_path, from_year, _year_month(F.get(first, F.lit(0)), F.get(first, F.lit(1))))


def calendar_trap(url: Column, pairs: Column, now_hours: Column, p: Traps = Traps()) -> Column:
    return F.coalesce(url_month(url, pairs) > month_of_hours(now_hours) + p.horizon_months, F.lit(False))


def session_trap(pairs: Column, p: Traps = Traps()) -> Column:
    return F.exists(pairs, lambda x: F.lower(x["k"]).isin(SESSION_KEYS) & high_entropy(x["v"], p.token_length))


def facet_count(pairs: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.filter(pairs, lambda x: F.lower(x["k"]).isin(FACET_KEYS)), lambda x: x["k"])))


def may_be_trap(url: Column) -> Column:
    """A cheap first test: URLs without a query and without a year in their path bear no signature."""
    return (F.instr(url, "?") > 0) | url.rlike("/(?:199|20[0-9])[0-9]/")


def trap_kind(url: Column, pairs: Column, now_hours: Column, p: Traps = Traps()) -> Column:
    """calendar, session, faceted or none: the first that applies. ``pairs`` are the ``query_pairs`` of the URL, best
    in a column of their own, so that they are taken apart once."""
    kind = F.when(calendar_trap(url, pairs, now_hours, p), "calendar").when(session_trap(pairs, p), "session").when(facet_count(pairs) >= p.facet_limit, "faceted").otherwise("none")
    return F.when(may_be_trap(url), kind).otherwise("none")
