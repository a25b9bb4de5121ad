"""Canonical URLs under policies of single hosts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.urls import canonical_url, canonicalize
from ..schema import CanonPolicy

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


@F.pandas_udf(StringType())
def _under_policy(raw: pd.Series, base: pd.Series, policy: pd.Series) -> pd.Series:
    known: dict[str, CanonPolicy] = {}
    out = []
    for r, b, p in zip(raw, base, policy, strict=True):
        if p not in known:
            known[p] = CanonPolicy(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(p).items()})
        out.append(canonicalize(r, b, known[p]))
    return pd.Series(out, dtype=object)


def canonical_by_host(urls: DataFrame, policies: DataFrame, url: str = "url", base: str | None = None, default: CanonPolicy = CanonPolicy()) -> DataFrame:
    """Adds ``canonical``: each URL under the policy of its own host, or of its base's where it names none.

    ``policies`` has one row for a host, in lower case, with any of the fields of ``CanonPolicy``; a missing or null
    field is the default's. Hosts without a row, most of them, take the default in expressions. The join is the
    optimizer's: neither side is forced. A URL that is no http(s) URL is null; more rows for a host raise an error."""
    fields = [c for c in policies.columns if c in CanonPolicy.__dataclass_fields__]
    told = F.to_json(F.struct(*fields)) if fields else F.lit("{}")
    rules = policies.groupBy(F.col("host").alias("__host")).agg(F.count("*").alias("__n"), F.first(told).alias("__policy"))
    rules = rules.select("__host", F.when(F.col("__n") == 1, F.col("__policy")).otherwise(F.raise_error(F.lit("two policies of one host"))).alias("__policy"))
    origin = F.lit(None).cast("string") if base is None else F.col(base)
    own = lambda c: F.nullif(F.regexp_extract(c, _AUTHORITY, 1), F.lit(""))
    joined = urls.withColumn("__host", F.lower(F.coalesce(own(F.col(url)), own(origin)))).join(rules, "__host", "left")
    special = F.col("__policy").isNotNull()
    # each branch sees nulls in place of the other's rows, as both are evaluated for all
    plain = canonical_url(F.when(~special, F.col(url)), origin, default)
    ruled = _under_policy(F.when(special, F.col(url)), origin, F.coalesce("__policy", F.lit("{}")))
    return joined.withColumn("canonical", F.when(special, ruled).otherwise(plain)).drop("__host", "__policy")
