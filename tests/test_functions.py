import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crawlscape.functions import content, freshness, importance, keys, politeness, traps, urls
from crawlscape.schema import CanonPolicy

HOURS = 494_520  # 2026-06-01


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize("raw", ["HTTP://Example.com:80/a/b/../c?utm_source=x&id=7#top", "http://EXAMPLE.com/%61/c?id=7", "http://example.com/a/c?id=7&gclid=1"])
def test_variants_collapse(spark, raw):
    assert urls.canonicalize(raw) == "http://example.com/a/c?id=7"
    assert one(spark, urls.canonical_url(F.lit(raw))) == "http://example.com/a/c?id=7"


def test_distinct_urls_stay_apart():
    raws = ["http://e.com/a?id=1", "http://e.com/a?id=2", "http://e.com/a/", "http://e.com/A", "http://e.com:8080/a", "https://e.com/a", "http://e.com/a%2Fb", "http://e.com/a/b"]
    assert len({urls.canonicalize(r) for r in raws}) == len(raws)


@pytest.mark.parametrize("raw", ["mailto:a@b.c", "javascript:void(0)", "tel:+1", "data:text/plain,x", "ftp://e.com/", "/relative", "http://", None, "http://e.com:bad/"])
def test_not_crawlable(raw):
    assert urls.canonicalize(raw) is None


def test_relative_international_and_policies():
    assert urls.canonicalize("../c?id=7", "http://e.com/a/b/page.html") == "http://e.com/a/c?id=7"
    assert urls.canonicalize("http://münchen.de/") == urls.canonicalize("http://xn--mnchen-3ya.de/") == "http://xn--mnchen-3ya.de/"
    assert urls.canonicalize("http://e.com/?b=2&a=1&utm_medium=x&fbclid=y&a=0") == "http://e.com/?a=0&a=1&b=2"
    assert urls.canonicalize("http://e.com/a//b/index.html", policy=CanonPolicy(fold_index=True, collapse_slash=True, fold_trailing=True)) == "http://e.com/a/b"
    assert urls.canonicalize("http://e.com/?keep=1&x=2", policy=CanonPolicy(query_allow=("keep",))) == "http://e.com/?keep=1"
    assert urls.canonicalize("http://e.com/?q=a+b%26c") == "http://e.com/?q=a+b%26c"


def test_canonical_is_idempotent(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(urls.canonical_url(F.col("url")).alias("a")).select("a", urls.canonical_url(F.col("a")).alias("b"))
    assert rows.where("a <> b or a is null").count() == 0
    both = spark.read.parquet(f"{sf}/pages.parquet").select(urls.canonical_url(F.col("url")).alias("a"), urls.canonical_udf()(F.col("url"), F.lit(None).cast("string")).alias("b"))
    assert both.where("a <> b").count() == 0


@pytest.mark.parametrize(("host", "domain"), [("www.example.com", "example.com"), ("a.b.example.com", "example.com"), ("shop.example.co.uk", "example.co.uk"), ("user.github.io", "user.github.io"), ("foo.s3.amazonaws.com", "foo.s3.amazonaws.com"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1")])
def test_registrable_domain(spark, host, domain):
    assert one(spark, urls.registrable_domain(F.lit(host))) == domain


def test_keys(spark):
    assert one(spark, keys.host_key(F.lit("rust-lang.org"))) == np.uint64(0xBD81FC1C46F41981).astype(np.int64)
    seeded = xxhash.xxh64_intdigest((0x9E3779B97F4A7C15).to_bytes(8, "little") + b"/x")
    assert one(spark, keys.path_key(F.lit("/x"))) == np.uint64(seeded).astype(np.int64)
    assert one(spark, keys._xxh64_arrow(F.lit(b"abc"))) == one(spark, keys.xxh64(F.lit("abc")))
    order = [r[0] for r in spark.createDataFrame([(-1,), (1,), (-(1 << 63),), ((1 << 63) - 1,)], "k long").orderBy(keys.unsigned(F.col("k"))).collect()]
    assert order == [1, (1 << 63) - 1, -(1 << 63), -1]
    for v in (0, 5, -5, (1 << 62), -(1 << 63), -1):
        assert one(spark, keys.unsigned_mod(F.lit(v).cast("long"), 7)) == (v % (1 << 64)) % 7
        assert one(spark, keys.unzigzag(keys.zigzag(F.lit(v).cast("long")))) == v
        assert one(spark, keys.bit_width(F.lit(v).cast("long"))) == (v % (1 << 64)).bit_length()
    assert one(spark, keys.parse_key(F.lit("0xFFFFFFFFFFFFFFFF"))) == -1
    assert one(spark, keys.parse_key(F.lit("42"))) == 42
    assert one(spark, keys.parse_key(F.lit("zz"))) is None


def test_jump_hash_moves_few():
    k = np.arange(20_000, dtype=np.int64) * 7919
    a, b = keys._jump(k, 10), keys._jump(k, 11)
    moved = a != b
    assert (b[moved] == 10).all() and 0.07 < moved.mean() < 0.11
    assert set(keys._jump(k, 1)) == {0}


@pytest.mark.parametrize(("url", "kind"), [
    ("http://e.com/2031/07/", "calendar"), ("http://e.com/2028/01/", "calendar"), ("http://e.com/c?year=2033&month=9", "calendar"), ("http://e.com/c?date=2030-11-02", "calendar"),
    ("http://e.com/2026/07/", "none"), ("http://e.com/2019/04/post", "none"), ("http://e.com/p/4821/detail", "none"), ("http://e.com/issues/2145", "none"),
    ("http://e.com/l?color=red&size=m&brand=x", "faceted"), ("http://e.com/l?color=red&size=m&page=2", "none"),
    ("http://e.com/p?phpsessid=0123456789abcdef0123456789abcdef", "session"), ("http://e.com/p?sid=42", "none"),
])
def test_trap_kinds(spark, url, kind):
    assert one(spark, traps.trap_kind(F.lit(url), traps.query_pairs(F.lit(url)), F.lit(HOURS))) == kind


def test_change_rate_bands(spark):
    rate = lambda n, x, s, span: one(spark, freshness.change_rate(F.lit(n), F.lit(x), F.lit(s), F.lit(span)))
    assert 0.0090 <= rate(11, 2, 0, 240) <= 0.0130
    assert rate(11, 9, 0, 240) > 0.075
    assert rate(1, 0, 0, 0) == 1 / 8760
    assert rate(11, 2, 8, 240) < rate(11, 2, 0, 240)


def test_next_due_and_interval(spark):
    due = one(spark, freshness.next_due(F.lit(1000).cast("long"), F.lit(48.0), F.lit(77).cast("long"), F.lit(0).cast("long")))
    assert 1048 <= due < 1072
    assert one(spark, freshness.next_due(F.lit(10).cast("long"), F.lit(1.0), F.lit(5).cast("long"), F.lit(100).cast("long"))) == 101
    intervals = [one(spark, freshness.target_interval(F.lit(1.0), F.lit(0.02), F.lit(t))) for t in (1e-6, 1e-3, 0.1, 10.0)]
    assert intervals == sorted(intervals)
    assert freshness.tau_step(1.0, 200, 100) == 1.05 and freshness.tau_step(1.0, 50, 100) == 0.95 and freshness.tau_step(1.0, 101, 100) == 1.0


def test_importance_levels(spark):
    assert [one(spark, importance.front_bucket(F.lit(p))) for p in (0.0, 1.0, 0.5, 0.25, 1e-9)] == [0, 63, 59, 55, 0]
    assert [one(spark, importance.quantize(F.lit(p), 12)) for p in (-1.0, 2.0, 0.5)] == [0, 11, 11]
    assert [one(spark, importance.retry_backoff(F.lit(r))) for r in (0, 1, 2, 5, 9, 40)] == [1, 1, 2, 16, 168, 168]
    assert one(spark, importance.host_budget(F.lit(3))) == 112


def test_rate_control(spark):
    event = lambda s, lat, ra=0: F.struct(F.lit(s).cast("long").alias("status"), F.lit(ra).cast("long").alias("retry_after"), F.lit(lat).cast("long").alias("latency"))
    fold = lambda *e: one(spark, politeness.fold_outcomes(F.array(*e), F.lit(0).cast("long")))
    assert fold(event(503, 10)).interval == 2000
    assert fold(event(503, 10, 9000)).interval == 9000
    assert fold(*[event(200, 10)] * 20).interval == 250
    assert fold(event(200, 100), event(200, 900)).interval == int(900 * 1.3)
    dead = fold(*[event(503, 10)] * 12)
    assert dead.interval == 300_000 and dead.dead and dead.errors == 12


def test_simhash_and_changes(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "THE quick, brown fox!"), (3, ""), (4, "entirely different words here")], "k int, t string")
    got = {r.k: r.simhash for r in content.simhash(docs, "k", "t").collect()}
    assert got[1] == got[2] != got[4] and got[3] == 0
    kind = lambda a, b, x, y: one(spark, content.change_kind(F.lit(a), F.lit(b), F.lit(x), F.lit(y)))
    assert [kind(1, 1, 0, 99), kind(1, 2, 8, 9), kind(1, 2, 0, 255), kind(1, 2, 0, 0)] == ["none", "cosmetic", "real", "cosmetic"]


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 40)
    sims = [int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 5), replace=False)) for b in np.repeat(base, 4)]
    rows = spark.createDataFrame(list(enumerate(sims)), "k long, s long")
    points = {}
    for k, s in enumerate(sims):
        points.setdefault(s, k)
    wanted = {(min(a, b), max(a, b)) for s, a in points.items() for t, b in points.items() if a < b and (s ^ t).bit_count() <= 3} | {(points[s], k) for k, s in enumerate(sims) if points[s] != k}
    assert {(r.a, r.b) for r in content.near_pairs(rows, "k", "s").collect()} == wanted


def test_near_pairs_are_single_and_broadcast_nothing(spark):
    sims = [5, 5, 7, 1 << 40, (1 << 40) + 3, 1 << 59, 0, 0]
    found = content.near_pairs(spark.createDataFrame(list(enumerate(sims)), "k long, s long"), "k", "s", width=60)
    near = [(a, b, (sims[a] ^ sims[b]).bit_count()) for a in (0, 2, 3, 4, 5) for b in (2, 3, 4, 5) if a < b]
    assert sorted((r.a, r.b, r.distance) for r in found.collect()) == sorted([(0, 1, 0), *(p for p in near if p[2] <= 3)])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_normalize_body(spark):
    assert one(spark, content.normalize_body(F.lit(" a\t\nb\x0b c d "))) == "a b c d"
