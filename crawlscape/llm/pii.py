r"""Personal data by weak supervision, in column expressions only.

Regexes propose spans: the four base kinds with their validity checks, and wider
kinds. Labelers vote on each span (+1, -1 or 0): validity, gazetteers, cue words
before the span, its edges, and variety of its digits. The votes of all documents
are counted by pattern, and expectation-maximisation over these counts, which are
bounded by the number of patterns and not by the data, estimates how reliable each
labeler is. A logistic classifier over votes, kind and length is then trained on
the estimated probabilities and decides on the spans that are no base spans.

Spans come from \G(.*?)(pattern): the lazy gap gives a match's distance to the one
before, and so its place, in a single pass; possessive quantifiers and a look-behind
keep every pattern linear and free of recursion on very long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parquet

# Base kinds, in the order of the results, with the first test a text has to pass.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
}
WIDER = {
    "handle": (r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
    "national": (r"(?:(?<![0-9+])|\G)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    "ssn": (r"(?:(?<![0-9-])|\G)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "secret": (r"(?:(?<![0-9A-Za-z])|\G)(?:[0-9a-f]{32,64}+|[A-Z]{4}[0-9A-Z]{16}+)(?![0-9A-Za-z])", r"[0-9a-f]{32}|[A-Z]{4}[0-9A-Z]{16}"),
}
KINDS = [*BASE, *WIDER]
# Gazetteers and cue words.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "dev", "app", "ai", "eu", "de", "at", "ch", "fr", "be", "lu", "es", "pt", "mx", "ar", "cl", "co", "it", "nl", "uk", "ie", "us", "ca", "au", "nz", "in", "jp", "cn", "kr", "br", "pl", "cz", "se", "no", "dk", "fi", "ru"]
# in English, German, French and Spanish
CUES = {
    "email": "mail|contact|write|reach|kontakt|schreib|courriel|contacte|correo|escrib",
    "ip": "ip|addr|host|server|login|adresse|rechner|serveur|servidor",
    "card": "card|visa|credit|pay|account|karte|konto|carte|compte|tarjeta|cuenta",
    "phone": "phone|tel|call|mobile|fax|anruf|handy|appel|portable|llam|movil|m\u00f3vil",
    "handle": "mail|contact|write|reach|kontakt|schreib|courriel|contacte|correo|escrib",
    "national": "phone|tel|call|mobile|fax|anruf|handy|appel|portable|llam|movil|m\u00f3vil",
    "ssn": "ssn|social|security|sozial|securite|s\u00e9curit\u00e9|seguridad",
    "secret": "token|secret|key|password|auth|passwort|schl\u00fcssel|mot de passe|clave|contrase",
}
VOTES = ["valid", "listed", "cued", "edged", "varied"]
CONTEXT, THRESHOLD = 32, 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, divisible by ten."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48)
    doubled = F.transform(each, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind in ("phone", "national"):
        return F.length(_digits(value)).between(8, 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, the end exclusive."""
    pattern, first = (BASE | WIDER)[kind]
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps, values = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    placed = F.aggregate(F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("g"), v.alias("v"))), start, add, lambda acc: acc["out"])
    return F.when(text.rlike(first), placed).otherwise(empty)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judged(text: Column, kind: str, x: Column) -> Column:
    """A span with its votes and features."""
    value, never = x["value"], F.lit(False)
    before = F.lower(F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT))))
    around = F.concat(F.substring(text, F.greatest(x["start"], F.lit(1)), F.when(x["start"] > 0, 1).otherwise(0)), F.lit("\x00"), F.substring(text, x["end"] + 1, F.lit(1)))
    digits = _digits(value)
    tail = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
    listed = {
        "email": _vote(tail.isin(TOP_DOMAINS), F.length(tail) < 2),
        "handle": _vote(tail.isin(TOP_DOMAINS), F.length(tail) < 2),
        "ip": _vote(~value.rlike(r"^(?:0|127|255)\."), value.rlike(r"^0+\.|^127\.")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), never),
        "phone": _vote(value.rlike(r"^\+(?:1|3[0-9]|4[0-9])"), never),
    }.get(kind, F.lit(0))
    bounded = around.rlike("^[A-Za-z0-9]|[A-Za-z0-9]$")
    same = digits.rlike(r"^([0-9])\1+$")
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        F.lit(kind).alias("kind"),
        F.coalesce(_valid(kind, value), never).alias("ok"),
        _vote(F.coalesce(_valid(kind, value), never), ~F.coalesce(_valid(kind, value), never)).alias("valid"),
        listed.alias("listed"),
        _vote(before.rlike(CUES[kind]), never).alias("cued"),
        _vote(never, bounded).alias("edged"),
        _vote(F.length(digits) > 7, same).alias("varied"),
        F.least(F.floor(F.length(value) / 8), F.lit(6)).cast("int").alias("size"),
    )


def _judge(text: Column, kind: str):
    return lambda x: _judged(text, kind, x)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__<kind>`` arrays of judged spans: invalid matches of base kinds are dropped."""
    t = F.col(text)
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", _spans(t, kind))
    for kind in KINDS:
        found = F.when(F.size(f"__{kind}") > 0, F.transform(f"__{kind}", _judge(t, kind)))
        kept = F.filter(found, lambda x: x["ok"]) if kind in BASE else found
        df = df.withColumn(f"__{kind}", F.coalesce(kept, F.array()))
    return df


def vote_counts(df: DataFrame) -> list[tuple]:
    """(kind, size, votes..., count) of all spans: at most kinds x sizes x 3 ** labelers rows."""
    spans = df.select(F.explode(F.concat(*[F.col(f"__{k}") for k in KINDS])).alias("s"))
    keys = ["kind", "size", *VOTES]
    return [tuple(r) for r in spans.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).count().orderBy(*keys).collect()]


def estimate(counts: list[tuple], rounds: int = 50) -> list[float]:
    """Probability of each vote pattern to be personal data: EM over labelers that err independently.

    For every labeler the chances of its votes are kept for both classes; the share of
    personal data is kept for each kind.
    """
    mean = [0.9 if sum(c[2:-1]) > 0 else 0.5 if sum(c[2:-1]) == 0 else 0.1 for c in counts]
    kinds = sorted({c[0] for c in counts})
    for _ in range(rounds):
        share = {}
        for k in kinds:
            rows = [(p, c[-1]) for p, c in zip(mean, counts, strict=True) if c[0] == k]
            share[k] = (sum(p * n for p, n in rows) + 1) / (sum(n for _, n in rows) + 2)
        chance = []
        for v in range(len(VOTES)):
            by = {(cls, x): 0.5 for cls in (0, 1) for x in (-1, 0, 1)}
            for p, c in zip(mean, counts, strict=True):
                by[(1, c[2 + v])] += p * c[-1]
                by[(0, c[2 + v])] += (1 - p) * c[-1]
            total = [sum(by[(cls, x)] for x in (-1, 0, 1)) for cls in (0, 1)]
            chance.append({k: n / total[k[0]] for k, n in by.items()})
        new = []
        for c in counts:
            odds = math.log(share[c[0]] / (1 - share[c[0]]))
            odds += sum(math.log(ch[(1, x)] / ch[(0, x)]) for ch, x in zip(chance, c[2:-1], strict=True))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(new, mean, strict=True)), default=0.0) < 1e-6:
            return new
        mean = new
    return mean


def _features(kind: str, size: int, votes: tuple) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], size / 6, *[float(v > 0) for v in votes], *[float(v < 0) for v in votes]]


def train(counts: list[tuple], steps: int = 400) -> list[float]:
    """Weights of a logistic classifier fitted to the estimated probabilities, weighted by log counts."""
    size = len(_features("", 0, (0,) * len(VOTES)))
    weights = [0.0] * size
    rows = [(_features(c[0], c[1], c[2:-1]), p, math.log1p(c[-1])) for c, p in zip(counts, estimate(counts), strict=True)]
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for x, p, n in rows:
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True))))
            for i, a in enumerate(x):
                slope[i] += n * (q - p) * a / total
        weights = [w - 2.0 * g for w, g in zip(weights, slope, strict=True)]
    return weights


def probability(x: Column, weights: list[float]) -> Column:
    """The classifier as an expression over a judged span."""
    bias, rest = weights[0], weights[1:]
    kinds, (size,), votes = rest[: len(KINDS)], rest[len(KINDS) : len(KINDS) + 1], rest[len(KINDS) + 1 :]
    odds = F.lit(bias) + x["size"] / F.lit(6.0) * size
    for k, w in zip(KINDS, kinds, strict=True):
        odds = odds + F.when(x["kind"] == k, w).otherwise(0.0)
    for i, v in enumerate(VOTES):
        odds = odds + F.when(x[v] > 0, votes[i]).when(x[v] < 0, votes[len(VOTES) + i]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_pii(df: DataFrame, text: str = "text", weights: list[float] | None = None, keep_text: bool = True) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans``, arrays of spans by kind and start, to every row.

    A null text has no spans. Base spans stay whatever the classifier says; a wider span
    is added if the classifier trusts it and it overlaps no base span. Where the weights
    have to be estimated first, the judged spans are written once, with the rows
    (without their text on request), so that texts are searched a single time.
    """
    judged = candidates(df, text)
    if weights is None:
        judged = Scratch(df.sparkSession, "pii").keep(judged if keep_text else judged.drop(text), "judged")
        weights = train(vote_counts(judged))
    base = F.concat(*[F.col(f"__{k}") for k in BASE])
    judged = judged.withColumn("base_spans", base)
    clear = lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter(F.concat(*[F.col(f"__{k}") for k in WIDER]), lambda x: (probability(x, weights) >= THRESHOLD) & clear(x))
    return judged.withColumn("all_spans", F.concat("base_spans", more)).drop(*[f"__{k}" for k in KINDS])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; spans that overlap become one."""
    own = f"__row.`{text}`"
    found = find_pii(df.select(F.struct("*").alias("__row")), own)
    order = F.array_sort(F.transform("all_spans", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(own), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    clean = F.aggregate(order, start, add, lambda acc: F.concat(acc["out"], F.substring(F.col(own), acc["at"] + 1, F.length(own))))
    masked = F.when(F.size("all_spans") > 0, clean).otherwise(F.col(own)).alias(text)
    return found.select(*[masked if c == text else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts, their digest, and all spans. A null text is an empty one and
    has none; repeated rows are searched each; an empty table has no rows."""
    docs = parquet(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_pii(docs, keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))
