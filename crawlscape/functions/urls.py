"""URL identity: canonical form, query filtering, host grouping and raw splits.

``canonicalize`` is the full rule (relative references, dot segments, international
hosts, percent normal form, policies) behind an Arrow UDF. ``canonical_url`` is the
same rule as column expressions for absolute http(s) URLs with ASCII hosts and no dot
segments, and hands every other URL to the UDF.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CanonPolicy

# Parameters that track visits, and index files.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_eid", "ref", "ref_src", "ref_url", "igshid", "yclid", "_ga"]
INDEX_FILES = ["index.html", "index.htm", "index.php", "default.asp", "default.aspx"]
# A small public-suffix table: rules of two and more labels; any other last label is a suffix itself.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "co.nz", "com.br", "co.in", "co.kr", "com.cn", "com.tr", "co.za", "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "s3.amazonaws.com", "web.app", "pages.dev"]

_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_PATH_SAFE = "/%:@!$&'()*+,;=~-._[]"


def normalize_percent(text: str) -> str:
    """Escapes of unreserved characters are resolved, all others written in upper case."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()

    return _ESCAPE.sub(one, text)


def filter_query(query: str, policy: CanonPolicy = CanonPolicy()) -> str:
    kept = []
    for part in query.split("&"):
        if not part or ";" in part:
            continue
        if re.search(r"%(?![0-9A-Fa-f]{2})", part):
            continue
        ((k, v),) = parse_qsl(part, keep_blank_values=True, errors="surrogateescape") or [("", "")]
        if policy.query_allow:
            if k not in policy.query_allow:
                continue
        elif k in TRACKING or k in policy.query_deny:
            continue
        kept.append((k.encode("utf-8", "surrogateescape"), v.encode("utf-8", "surrogateescape")))
    return "&".join(quote_plus(k, safe="~") + ("=" + quote_plus(v, safe="~") if v else "") for k, v in sorted(kept))


def _resolved(path: str) -> str:
    """An absolute path without dot segments; one that ends in them ends in a slash."""
    out: list[str] = []
    segments = path.split("/")[1:]
    for k, segment in enumerate(segments):
        if segment in (".", ".."):
            if segment == ".." and out:
                out.pop()
            if k == len(segments) - 1:
                out.append("")
        else:
            out.append(segment)
    return "/" + "/".join(out)


def canonicalize(raw: str | None, base: str | None = None, policy: CanonPolicy = CanonPolicy()) -> str | None:
    """The canonical URL, or None for what can't be crawled."""
    if raw is None:
        return None
    raw = raw.strip()
    if re.search(r"[\x00-\x1f\x7f]", raw):
        return None
    try:
        if base and not (_SCHEME.match(raw) and not raw.lower().startswith(("http:", "https:"))):
            raw = urljoin(base, raw)
        parts = urlsplit(raw)
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
    except ValueError:
        return None
    if scheme not in ("http", "https") or not host:
        return None
    host = host.lower().removesuffix(".")
    if not host:
        return None
    if not host.isascii():
        import idna

        try:
            host = idna.encode(host, uts46=True, transitional=False).decode()
        except idna.IDNAError:
            return None
    elif not re.fullmatch(r"[a-z0-9._-]+|[0-9a-f:.]+", host):
        return None
    host = f"[{host}]" if ":" in host else host
    if port == {"http": 80, "https": 443}[scheme]:
        port = None
    path = _resolved(parts.path)
    path = normalize_percent(quote(path, safe=_PATH_SAFE))
    if policy.collapse_slash:
        path = re.sub("/+", "/", path)
    if policy.fold_index and path.rpartition("/")[2] in INDEX_FILES:
        path = path.rpartition("/")[0] + "/"
    if policy.fold_trailing and len(path) > 1:
        path = path.removesuffix("/") or "/"
    query = filter_query(parts.query, policy)
    if policy.fold_case:
        path, query = path.lower(), query.lower()
    return f"{scheme}://{host}" + (f":{port}" if port is not None else "") + path + (f"?{query}" if query else "")


def canonical_udf(policy: CanonPolicy = CanonPolicy()):
    @F.pandas_udf("string")
    def canonical(raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([canonicalize(r, b, policy) for r, b in zip(raw, base, strict=True)], dtype=object)

    return canonical


def kept_query(query: Column, policy: CanonPolicy = CanonPolicy()) -> Column:
    """Parameters without the tracking ones, sorted, for queries without escapes."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
    if policy.query_allow:
        wanted = F.filter(pairs, lambda x: x["k"].isin(list(policy.query_allow)))
    else:
        wanted = F.filter(pairs, lambda x: ~x["k"].isin([*TRACKING, *policy.query_deny]))
    trimmed = F.transform(wanted, lambda x: F.struct(x["k"], F.regexp_replace(x["p"], "=$", "").alias("p")))
    return F.array_join(F.transform(F.array_sort(trimmed), lambda x: x["p"]), "&")


def canonical_url(url: Column, base: Column | None = None, policy: CanonPolicy = CanonPolicy()) -> Column:
    """Canonical form in expressions where the URL is plain, through the UDF elsewhere."""
    plain = url.rlike(r"^(?i:https?)://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9/_~.-]*)?(\?[A-Za-z0-9&=_.~-]*)?(#.*)?$") & ~url.rlike(r"/\.\.?(/|\?|#|$)")
    scheme = F.lower(F.substring_index(url, ":", 1))
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    authority = F.regexp_extract(rest, "^[^/?]*", 0)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, ":[0-9]+$", "")), r"\.$", "")
    port = F.regexp_extract(authority, "(:[0-9]+)$", 1)
    port = F.when((scheme == "http") & (port == ":80"), "").when((scheme == "https") & (port == ":443"), "").otherwise(port)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    if policy.collapse_slash:
        path = F.regexp_replace(path, "/+", "/")
    if policy.fold_index:
        path = fold_index(path)
    if policy.fold_trailing:
        path = fold_trailing(path)
    query = kept_query(F.when(F.instr(rest, "?") > 0, F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(""), policy)
    if policy.fold_case:
        path, query = F.lower(path), F.lower(query)
    built = F.concat(scheme, F.lit("://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(plain, built).otherwise(canonical_udf(policy)(F.when(~plain, url), F.lit(None).cast("string") if base is None else base))


def fold_index(path: Column) -> Column:
    return F.regexp_replace(path, "/(" + "|".join(map(re.escape, INDEX_FILES)) + ")$", "/")


def fold_trailing(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/$", ""), F.lit("")), F.lit("/"))).otherwise(path)


def collapse_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/+", "/")


def host_of(url: Column) -> Column:
    """Raw split: whatever stands before the first slash after the scheme."""
    return F.regexp_extract(url, "^(?:[^/:]*://)?([^/]*)", 1)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, "^(?:[^/:]*://)?[^/]*(/.*)$", 1)
    return F.when(path == "", "/").otherwise(path)


def registrable_domain(host: Column) -> Column:
    """The public suffix and one label more; a host that is a suffix stays as it is."""
    clean = F.regexp_replace(F.lower(host), r"\.$", "")
    labels = F.split(clean, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(n, F.lit(k))), ".")
    size = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in SUFFIXES}):
        size = F.when((n >= k) & tail(k).isin([s for s in SUFFIXES if s.count(".") + 1 == k]), k).otherwise(size)
    joined = F.array_join(F.slice(labels, F.greatest(n - size, F.lit(1)), n), ".")
    return F.when(clean.rlike(r"^[0-9.]+$"), clean).otherwise(joined)


def group_of(url: Column, full_host: bool = False) -> Column:
    host = F.regexp_replace(host_of(url), ":[0-9]+$", "")
    return host if full_host else registrable_domain(host)
