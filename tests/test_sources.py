import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlscape.operators import canonical
from crawlscape.plans import fleet
from crawlscape.schema import Resolver
from crawlscape.sources import captures, dns, layout, pages, robots, sitemaps, suffixes
from crawlscape.sources.store import Collection, Store


def test_captures(spark, tmp_path):
    lines = [{"url": "http://A.com/x#y", "host": "a.com", "timestamp": "20240102030405", "status": "200"}, {"url": "http://b.com/"}, {"host": "c.com"}]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "not json"]))
    rows = captures.read_captures(spark, str(tmp_path))
    assert rows.where("skipped").count() == 2 and rows.count() == 4
    seeds = {r.url: r.host for r in captures.seed_discoveries(rows).collect()}
    assert seeds == {"http://a.com/x": "a.com", "http://b.com/": "b.com"}
    stream = spark.createDataFrame([(json.dumps(lines[1]),), (" ",)], "value string")
    assert [r.host for r in captures.decode_lines(stream).collect()] == ["b.com"]


BODY = b"\xef\xbb\xbfUser-agent: Other\nDisallow: /\n\nUser-agent: crawl\nUser-agent: x\nDisallow: /private/ # no\nAllow: /private/public/\nDisallow: /*.pdf$\nCrawl-delay: 1.5\nSitemap: http://e/s.xml\n\nUser-agent: *\nDisallow: /all\n"


def test_robots(spark):
    rules, delay, maps = robots.parse_robots(BODY, "crawler/1.0")
    assert delay == 1.5 and maps == ["http://e/s.xml"] and len(rules) == 3
    paths = {"/private/public/report.pdf": True, "/private/secret.txt": False, "/notes.pdf": False, "/public/report.pdfx": True, "/": True}
    rows = spark.createDataFrame([(p, BODY) for p in paths], "path string, body binary").withColumn("parsed", robots.robots_rules(F.col("body"), "crawler/1.0"))
    assert {r.path: r.a for r in rows.select("path", robots.allowed(F.col("parsed"), F.col("path")).alias("a")).collect()} == paths
    assert robots.parse_robots(b"", "c") is None and robots.pattern_regex("") is None
    assert robots.pattern_regex("$") == "(?s)^"


def test_robots_exclude_pages(spark):
    urls = spark.createDataFrame([("h", "/all/x", 1), ("h", "/b", 1), ("g", "/all", 1)], "host string, path string, status int")
    hosts = spark.createDataFrame([("h", 200, BODY, 5, 2), ("g", 404, None, 5, 0)], "host string, http_status int, body binary, crawl_delay int, flags int")
    pages_, after = robots.apply_robots(urls, hosts, "nobody", 100)
    assert {(r.host, r.path): r.status for r in pages_.collect()} == {("h", "/all/x"): 7, ("h", "/b"): 1, ("g", "/all"): 1}
    assert {r.host: (r.flags, r.robots_expiry) for r in after.collect()} == {"h": (0, 124), "g": (2, 124)}


def test_sitemaps(spark, tmp_path):
    xml = b"<urlset xmlns='http://x'><url><loc> http://e.com/a </loc><lastmod>2020-01-02T03:04:05Z</lastmod></url><url><loc>http://e.com/b</loc><lastmod>1960-01-01</lastmod></url><url><loc>mailto:x</loc></url>"
    index, found = sitemaps.parse_sitemap(gzip.compress(xml + b"<url><loc>broken"))
    assert not index and found == [("http://e.com/a", 438315), ("http://e.com/b", None), ("mailto:x", None)]
    (tmp_path / "s.xml").write_bytes(xml + b"</urlset>")
    (tmp_path / "i.xml").write_bytes(b"<sitemapindex><sitemap><loc>http://e.com/s1.xml</loc></sitemap></sitemapindex>")
    entries = sitemaps.read_sitemaps(spark, str(tmp_path))
    assert {r.url: r.observed_at for r in sitemaps.discoveries(entries, 9).collect()} == {"http://e.com/a": 438315, "http://e.com/b": 9}
    assert [r.url for r in sitemaps.child_sitemaps(entries).collect()] == ["http://e.com/s1.xml"]
    assert sitemaps.parse_sitemap(None) == (False, []) and sitemaps.last_modified_hours("x") is None


def test_sitemaps_of_a_host_beyond_the_entry_limit(spark, tmp_path):
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.format_string("http://big.example/p%d", "id").alias("url"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = fleet.sitemap_parse(spark, str(tmp_path))
    assert got.count() == 60_000 > sitemaps.MAX_ENTRIES and got.select("loc").distinct().count() == 60_000
    entries = pages.select(F.lit("h").alias("host"), F.col("url").alias("x"), "page_id")
    assert sitemaps.packed(entries, "host", "x", "page_id", size=100_000).agg(F.max(F.length("body"))).head()[0] < 150_000


def test_links(spark):
    html = "<a href='/a?utm_source=1'>x</a><A HREF=\"b\">y</A><area href=/c><a href=\"/a\">again</a><a href='mailto:z'>"
    rows = spark.createDataFrame([(1, "http://e.com/d/", html), (2, "http://e.com/", None)], "page_id long, url string, html string")
    assert [r.target for r in pages.extract_links(rows).orderBy("position").collect()] == ["http://e.com/a", "http://e.com/d/b", "http://e.com/c"]


def test_links_leave_in_small_batches(spark):
    html = "".join(f"<a href='/p{k}'>x</a>" for k in range(40))
    rows = pa.RecordBatch.from_pylist([{"page_id": i, "url": "http://e.com/", "html": html if i % 2 else None, "level": 0} for i in range(1000)])
    made = list(pages.links_in(iter([rows])))
    assert sum(b.num_rows for b in made) == 500 * 40 and max(b.num_rows for b in made) <= 40 * pages.STEP // 2
    frame = spark.createDataFrame([(i, "http://e.com/", html) for i in range(10)], "page_id int, url string, html string")
    assert "MapInArrow" in pages.extract_links(frame)._jdf.queryExecution().executedPlan().toString()
    assert pages.extract_links(frame).count() == 400
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_dns(spark):
    rows = spark.createDataFrame([("a", 1, "1.2.3.4", 5), ("b", 1, "1.2.3.4", 10**6), ("b", 2, None, 0), ("b", 3, None, 0)], "host string, at int, ip string, ttl int")
    got = {r.host: r for r in dns.cached(rows, 10, Resolver()).collect()}
    assert got["a"].expiry == 61 and not got["a"].suppressed
    assert got["b"].failures == 2 and got["b"].suppressed and got["b"].expiry == 86401
    ips = spark.createDataFrame([("1.2.3.4",), ("::1",), ("x",)], "t string").select(dns.ip_bytes(F.col("t")).alias("b")).select("b", dns.ip_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in ips] == ["1.2.3.4", "::1", None] and len(ips[0].b) == 16


def test_layout_round_trip_and_pruning(spark, tmp_path):
    urls = spark.range(5000).select((F.col("id") % 50).alias("host_key"), F.col("id").alias("path_key"), (F.col("id") % 7).cast("byte").alias("status"), F.col("id").cast("int").alias("next_due"), F.concat(F.lit("http://e.com/"), F.col("id").cast("string")).alias("url"))
    layout.write_partition(urls, str(tmp_path / "u"), 4)
    back = spark.read.parquet(str(tmp_path / "u"))
    assert back.count() == 5000 and layout.read_urls(spark, str(tmp_path / "u")).where("url is null").count() == 0
    pruned = layout.host_range(back, 10, 12)
    assert pruned.count() == 300 and "PushedFilters: [IsNotNull(host_key), GreaterThanOrEqual(host_key,10)" in pruned._jdf.queryExecution().toString()
    chunks = layout.inspect(spark, str(tmp_path / "u"))
    size = chunks.agg(F.sum("bytes")).head()[0]
    assert size / 5000 < 40 and layout.encoding_counts(chunks).count() > 0
    layout.write_wheel(urls, str(tmp_path / "w"))
    wheeled = spark.read.parquet(str(tmp_path / "w"))
    assert layout.due_by_wheel(wheeled, F.lit(300)).count() == urls.where("next_due <> 0 and next_due <= 300").count()
    low, high = layout.split(back, 25)
    assert layout.merge(low, high).count() == 5000
    with pytest.raises(ValueError):
        layout.merge(back, high)


def test_store_recovers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "k", "k long, v string")
    assert store.rows().count() == 0
    store.append(spark.createDataFrame([(1, "put", 1, "a"), (2, "put", 2, "b")], "lsn long, op string, k long, v string"))
    store.checkpoint()
    assert store.append(spark.createDataFrame([(3, "del", 1, None), (4, "put", 3, "c")], "lsn long, op string, k long, v string")) == 4
    again = Store(spark, f"file://{tmp_path}/s", "k", "k long, v string")
    assert sorted(map(tuple, again.rows().collect())) == [(2, "b"), (3, "c")]
    again.checkpoint()
    assert again.get(spark.createDataFrame([(3,)], "k long")).head().v == "c"
    manifest = spark.createDataFrame([(0, 9, 1), (20, 29, 2)], "lo long, hi long, partition_id int")
    routed = Collection(manifest).route(spark.createDataFrame([(5,), (15,), (25,)], "k long"), F.col("k"))
    assert {r.k: r.partition_id for r in routed.collect()} == {5: 1, 15: None, 25: 2}


def test_store_survives_a_crash_in_a_commit(spark, tmp_path, monkeypatch):
    """A crash before, during and after the pointer is written leaves the old or the new generation."""
    root = tmp_path / "s"
    store = Store(spark, f"file://{root}", "k", "k long, v string")
    puts = lambda lsn, k: spark.createDataFrame([(lsn, "put", k, "x")], "lsn long, op string, k long, v string")
    keys = lambda: sorted(r.k for r in Store(spark, f"file://{root}", "k", "k long, v string").rows().collect())
    store.append(puts(1, 1))
    commit = Store._commit

    def never(self, pointer):
        raise OSError("crash before the pointer")

    monkeypatch.setattr(Store, "_commit", never)
    for act in (lambda: store.append(puts(2, 2)), store.checkpoint):
        with pytest.raises(OSError):
            act()
        assert keys() == [1]
    monkeypatch.setattr(Store, "_commit", commit)
    for broken in (b"", b"0123", b"00\n{}"):
        newest = max(int(f.name.removeprefix("CURRENT-")) for f in root.glob("CURRENT-*"))
        (root / f"CURRENT-{newest + 1:020d}").write_bytes(broken)
        assert keys() == [1]
    assert store.append(puts(3, 3)) == 3 and keys() == [1, 3]
    monkeypatch.setattr(Store, "tidy", never)
    with pytest.raises(TypeError):
        store.checkpoint()
    assert keys() == [1, 3]
    monkeypatch.undo()
    store.checkpoint()
    store.checkpoint()
    assert keys() == [1, 3] and len([f for f in root.glob("CURRENT-*")]) == 2 and len(list((root / "gen").iterdir())) == 2


def test_links_in_expressions(spark):
    html = """<!-- <a href="/no"> --><script>s = '<a href="/no">'</script><a class=x data-href="/no" href="/a?x=1&amp;y=2">1</a>
      <A
      HREF='/b>c'>2</A><area href=/c><a href = "/d" href="/no"><abbr href="/no"><a name=q><a href=""><a href="/a?x=1&amp;y=2">"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r.h for r in rows.select("page_id", pages.hrefs(F.col("html")).alias("h")).collect()}
    assert got == {1: pages.anchor_targets(html), 2: None, 3: []} and len(got[1]) == 5


def test_public_suffixes(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// a comment\ncom\nuk\nco.uk  and words\n*.ck\n!www.ck\nbücher.example\nexample\n\n")
    rules = suffixes.read_suffixes(spark, str(tmp_path / "rules.dat"))
    assert {(r.name, r.kind) for r in rules.collect()} == {("com", "plain"), ("uk", "plain"), ("co.uk", "plain"), ("ck", "any"), ("www.ck", "except"), ("xn--bcher-kva.example", "plain"), ("example", "plain")}
    wanted = {
        "com": "com", "a.com": "a.com", "x.A.com.": "a.com", "a.co.uk": "a.co.uk", "b.a.co.uk": "a.co.uk", "co.uk": "co.uk", "uk": "uk", "q.uk": "q.uk",
        "a.ck": "a.ck", "b.a.ck": "b.a.ck", "c.b.a.ck": "b.a.ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "one": "one", "a.one": "a.one", "b.a.one": "a.one",
        "1.2.3.4": "1.2.3.4", "s.t.xn--bcher-kva.example": "t.xn--bcher-kva.example", "": "",
    }
    hosts = spark.createDataFrame([(h,) for h in [*wanted, "a.com", None]], "host string")
    got = [(r.host, r.domain) for r in suffixes.registrable_domains(hosts, rules).collect()]
    assert sorted(got) == sorted(wanted.items())
    assert suffixes.registrable_domains(hosts.where("false"), rules).count() == 0


def test_policies_by_host(spark):
    policies = spark.createDataFrame([("a.com", True, None, ["id"]), ("b.com", False, True, None), ("twice.com", True, True, None), ("twice.com", False, True, None)], "host string, fold_trailing boolean, fold_case boolean, query_allow array<string>")
    rows = [
        (1, "http://A.com/x/?id=1&q=2", None, "http://a.com/x?id=1"),
        (2, "http://b.com/X/?Q=2", None, "http://b.com/x/?q=2"),
        (3, "http://c.com/X/?b=2&a=1&ref=z", None, "http://c.com/X/?a=1&b=2"),
        (4, "y/", "http://a.com:80/x/", "http://a.com/x/y"),
        (5, "//b.com/Q", "http://a.com/", "http://b.com/q"),
        (6, "mailto:x", "http://a.com/", None),
        (7, None, None, None),
    ]
    urls = spark.createDataFrame([r[:3] for r in rows], "id int, url string, base string")
    once = policies.where("host <> 'twice.com'")
    got = {r.id: r.canonical for r in canonical.canonical_by_host(urls, once, base="base").collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert canonical.canonical_by_host(urls, once.where("false"), base="base").where("canonical like '%/x/y/'").count() == 1
    with pytest.raises(Exception, match="two policies"):
        canonical.canonical_by_host(spark.createDataFrame([("http://twice.com/",)], "url string"), policies).collect()


def test_merge_takes_keys_as_unsigned(spark):
    low, middle = (spark.createDataFrame([(k,) for k in keys], "host_key long") for keys in ([1, 5], [2**62, -(2**62)]))
    assert layout.merge(low, middle).count() == 4
    with pytest.raises(ValueError, match="overlap"):
        layout.merge(low, spark.createDataFrame([(3,)], "host_key long"))
