"""Literal expected rows for operators whose rules SQL cannot mirror."""

import json

import pytest
from pyspark.sql import functions as F

from sitegauge.functions.text import wilson
from sitegauge.functions.urls import redact, same_site, url_key
from sitegauge.operators import answers, diff, graph, logs, pages, trends
from sitegauge.sources import crawl, tables, vendors
from sitegauge.sources.html import extract_html, pages_to_records

VECTORS = {
    "http://mysite.org/a": "https://mysite.org/a", "https://WWW.MySite.ORG/a": "https://mysite.org/a", "https://mysite.org./x": "https://mysite.org/x", "https://mysite.org:443/x": "https://mysite.org/x", "http://mysite.org:80/x": "https://mysite.org/x",
    "https://mysite.org:8080/x": "https://mysite.org:8080/x", "https://mysite.org/about/": "https://mysite.org/about", "https://mysite.org/": "https://mysite.org/", "https://mysite.org/a%2fb": "https://mysite.org/a%2Fb",
    "https://mysite.org/x?utm_source=tw&utm_medium=s&fbclid=1&gclid=2": "https://mysite.org/x", "https://mysite.org/x?ref=nav": "https://mysite.org/x?ref=nav", "https://mysite.org/x?refresh=1": "https://mysite.org/x?refresh=1", "https://mysite.org/x?b=2&a=1": "https://mysite.org/x?a=1&b=2",
    "https://mysite.org/x#section": "https://mysite.org/x", "": "", "http://[junk": "http://[junk", "https://e.x/?q=a%20b&e=": "https://e.x/?e=&q=a+b", "https://e.x/p?t=~*": "https://e.x/p?t=~%2A",
}


def test_url_identity(spark):
    rows = spark.createDataFrame([(u,) for u in VECTORS], "url string").select("url", url_key("url").alias("k"), url_key(url_key("url")).alias("kk")).collect()
    assert {r.url: r.k for r in rows} == VECTORS and all(r.k == r.kk for r in rows)
    assert spark.createDataFrame([(None,)], "url string").select(url_key("url").alias("k")).first().k is None
    site = spark.createDataFrame([("https://blog.e.x/", "www.e.x"), ("https://e.x/", "e.x"), ("https://notе.x/", "e.x"), ("", "e.x")], "u string, s string")
    assert [r[0] for r in site.select(same_site("u", "s", True)).collect()] == [True, True, False, False]


def test_redact(spark):
    df = spark.createDataFrame([("https://e.x/?key=abc&q=1&Token=z",), ("failed: password=hunter2, retry",), ("https://e.x/monkey=1",)], "u string")
    assert [r[0] for r in df.select(redact("u")).collect()] == ["https://e.x/?key=REDACTED&q=1&Token=REDACTED", "failed: password=REDACTED, retry", "https://e.x/monkey=1"]


def test_wilson(spark):
    got = spark.createDataFrame([(0, 1), (0, 30), (5, 5), (0, 0)], "h bigint, n bigint").select(wilson(F.col("h"), F.col("n")).alias("w")).collect()
    (a, b, c, d) = [r.w for r in got]
    assert a.high > 0.75 and b.high < 0.15 and c.high == 1 and c.low > 0.5 and (d.low, d.high) == (0, 1)
    assert all(r.w.low <= r.w.rate <= r.w.high for r in got[:3])


def test_noindex_tokens_are_not_trimmed(spark):
    rows = spark.createDataFrame([("noindex", ""), ("nofollow, none", ""), ("none", ""), ("", "NOINDEX")], "meta_robots string, x_robots_tag string")
    assert pages.noindex_pages(rows).count() == 3


def test_weekly_trend(spark):
    rows = spark.createDataFrame([("k", "2024-01-01", 0, 10, 4.0), ("k", "2024-01-02", 1, 0, 8.0), ("k", "2024-01-08", 0, 5, 3.0), ("k", "2024-01-15", 0, 5, 9.0)], "key string, d string, clicks bigint, impressions bigint, position double").withColumn("d", F.to_date("d"))
    got = [(str(r.week_start), r.avg_position) for r in trends.weekly_positions(rows, F.lit("2024-01-18").cast("date")).orderBy("week_start").collect()]
    assert got == [("2024-01-01", 4.8), ("2024-01-08", 3.0)]  # a day without impressions weighs one; the open week goes
    weekly = spark.createDataFrame([("k", f"2024-01-{d:02d}", 20, p) for d, p in ((1, 3.0), (8, 13.0), (15, 11.5))], "key string, week_start string, impressions bigint, avg_position double")
    assert trends.position_changes(weekly).first().change == "steady"  # within the deviation


def test_graph(spark):
    pages_ = spark.createDataFrame([("https://a/", "https://a/", 200, "", 1, ["https://a/old", "https://a/x", "https://a/x"]), ("https://a/old", "https://a/x", 200, "", 2, []), ("https://a/x", "https://a/x", 200, "", 3, ["https://a/"]), ("https://a/e", "https://a/e", -1, "timeout", 4, ["https://a/x"])], "url string, final_url string, status int, error_type string, fetch_seq bigint, internal_links array<string>")
    edges = graph.link_edges(pages_)
    assert sorted(map(tuple, edges.collect())) == [("https://a/", "https://a/x"), ("https://a/x", "https://a/")]
    nodes = spark.createDataFrame([(str(i),) for i in range(9)], "node string")
    refused = graph.orphan_pages(nodes, nodes.limit(0).withColumn("depth", F.lit(0)), nodes.withColumn("indexable", F.lit(True)), nodes.limit(1)).collect()
    assert len(refused) == 1 and refused[0].type == "refused"


def test_regressions_of_nothing_are_none(spark):
    rows = spark.createDataFrame([("k", "https://a/", "https://a/", 200, "", "", "", "https://a/", "text/html")], "key string, url string, final_url string, status int, error_type string, meta_robots string, x_robots_tag string, canonical string, content_type string")
    assert diff.crawl_regressions(rows, rows).count() == 0 and diff.pages_disappeared(rows, rows).count() == 0
    assert diff.pages_disappeared(rows, rows.limit(0)).count() == 1 and diff.pages_disappeared(rows, rows.limit(0), truncated=True).count() == 0


def test_mentions_count_labels_not_addresses(spark):
    rows = spark.createDataFrame([(1, 1, "See [Acme](https://acme.com/acme) and acme, www.acme.io. [https://acme.com](https://acme.com) Acmeville ACME!")], "conv_id bigint, turn bigint, text string")
    assert answers.brand_mentions(rows, {"acme": ["acme"]}).first().n == 3


def test_logs(spark):
    rows = spark.createDataFrame([("2001:db8::1 - x",), ("999.1.1.1 10.2.3.4",), ("bad",)], "line string")
    assert [r.line for r in logs.mask_client_ips(rows).collect()] == ["2001::x - x", "999.1.1.1 10.2.x.x", "bad"]
    assert logs.parse_access_log(rows).filter("ts is null").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "c1.jsonl").write_text(json.dumps({"url": "https://a/", "status": 200, "fetched_at": 2.0}) + "\n\n" + json.dumps({"url": "https://b/", "fetched_at": 1.0}) + "\n")
    got = crawl.read_crawl(spark, str(tmp_path / "c1.jsonl"))
    assert {r.url: (r.crawl_id, r.fetch_seq) for r in got.collect()} == {"https://a/": ("c1", 2), "https://b/": ("c1", 1)}
    pages_ = got.withColumns({"site": F.lit("s"), "crawl_id": F.lit("one")})
    meta = spark.createDataFrame([("s", "one", "t", 5, 2, False)], "site string, crawl_id string, producer string, max_pages int, pages_crawled bigint, truncated boolean").withColumn("finished_at", F.current_timestamp())
    crawl.write_crawl(pages_, meta, str(tmp_path / "store"))
    crawl.write_crawl(pages_.withColumn("crawl_id", F.lit("fragment")), meta.limit(0), str(tmp_path / "store"))
    assert crawl.read_complete(spark, str(tmp_path / "store")).count() == 2
    (tmp_path / "gsc.json").write_text('{"keys":["q","/p"],"clicks":1,"impressions":9,"position":2.5}\n{"keys":["q"],"clicks":1}\n')
    assert [r.page for r in crawl.read_search_analytics(spark, str(tmp_path / "gsc.json"), ["query", "page"]).collect()] == ["/p"]
    (tmp_path / "t.json").write_text(json.dumps({"property": "p", "complete": True, "rows": [{"date": "2024-01-01", "page": "/a", "source": "google", "medium": "organic", "sessions": 3, "key_events": 1}]}))
    rows, head = crawl.read_traffic_export(spark, str(tmp_path / "t.json"))
    assert rows.first().sessions == 3 and head.first().complete
    maps = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>"), ("c", "<urlset><url><loc> https://a/?x=1&amp;y=2 </loc></url></urlset>"), ("z", "<html>")], "sitemap string, body string")
    assert {(r.sitemap, r.kind, r.loc) for r in crawl.sitemap_urls(maps).collect()} == {("i", "index", "https://a/?x=1&y=2"), ("c", "urlset", "https://a/?x=1&y=2")}
    tables.append_history(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "h"))
    (tmp_path / "h" / "bad.json").write_text("{not json\n")
    assert tables.read_history(spark, str(tmp_path / "h"), "k string, v int, schema_version int").count() == 1
    findings = spark.createDataFrame([("x", "low", "u", "d", 7)], "type string, severity string, url string, detail string, extra int")
    tables.write_findings(findings, str(tmp_path / "f"), "audit", "2024-01-01")
    assert spark.read.parquet(str(tmp_path / "f")).first().evidence == {"extra": "7"}


def test_vendors(spark):
    ai = spark.createDataFrame([("r", "p", "v", 1, json.dumps({"annotations": [{"type": "url_citation", "url": "https://A/"}, {"type": "url_citation", "url": "https://a/"}, {"type": "url_citation"}, {"type": "url_citation"}, {"type": "other"}]}))], "run string, prompt string, provider string, sample int, json string")
    assert vendors.flatten_ai_samples(ai).count() == 3
    seen = spark.createDataFrame([("u", json.dumps({"inspectionResult": {"indexStatusResult": {"verdict": "PASS", "userCanonical": "http://a/", "googleCanonical": "https://www.a/"}}}))], "url string, json string")
    assert vendors.flatten_inspection(seen).first().canonical_mismatch is False
    links = spark.createDataFrame([(json.dumps({"source_url": "https://www.x.y/", "target_url": "/", "first_seen": 0, "nofollow": True, "response_code": 404}),)], "json string")
    row = vendors.normalize_backlinks(links, "semrush", broken=True).first()
    assert (row.source_domain, row.link_type, str(row.first_seen)) == ("x.y", "nofollow", "1970-01-01")


HTML = """<html lang="en"><head><title> T &amp; x</title><meta name="description" content="D"><meta name=robots content=noindex><link rel="canonical" href="/c"><meta property="og:title" content="O">
<link rel=alternate hreflang=de href="/de"><script type="application/ld+json">{"@type": "Article"}</script><script type="application/ld+json">{bad</script></head>
<body><h1>One</h1><h2>Two</h2><a href="/in?utm_source=1#f">i</a><a href="https://other.x/o" rel="nofollow">o</a><img src=a><img src=b alt=""><p>Hello there world</p><noscript>no</noscript></body></html>"""


def test_page_records(spark):
    rows = spark.createDataFrame([(1, "https://a.x/p", HTML), (2, "https://a.x/q", None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in pages_to_records(rows).collect()}
    r = got[1]
    assert (r.title, r.meta_description, r.meta_robots, r.canonical, r.lang, r.h1, r.h2) == ("T & x", "D", "noindex", "https://a.x/c", "en", ["One"], ["Two"])
    assert r.internal_links == ["https://a.x/in?utm_source=1"] and r.external_links == ["https://other.x/o"] and r.nofollow_links == ["https://other.x/o"]
    assert r.images == 2 and r.images_missing_alt == 1 and r.json_ld_types == ["Article"] and len(r.json_ld_errors) == 1 and r.og == {"og:title": "O"} and r.hreflang[0].href == "https://a.x/de"
    assert r.word_count == 10 and len(r.content_hash) == 16 and got[2].title == ""
    spark.udtf.register("extract_html", extract_html)
    rows.createOrReplaceTempView("raw_pages")
    assert spark.sql("SELECT * FROM extract_html(TABLE(SELECT page_id, url, html FROM raw_pages))").count() == 2


def test_streams_equal_batches(spark, tmp_path):
    from sitegauge.streaming import jobs

    line = '1.2.3.4 - - [{}/Jan/2024:0{}:00:00 +0000] "GET /" 200 "{}"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(line.format(d, h, b) for d, h, b in (("01", 1, "GPTBot"), ("01", 2, "bingbot GPTBot"), ("02", 3, "GPTBot"))) + "\nno time GPTBot\n")
    stream = jobs.stream_crawler_hits(spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line"))
    q = stream.writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.start)[:10], r.bot, r.hits) for r in spark.table("hits").collect()} == {("2024-01-01", "GPTBot", 2), ("2024-01-01", "bingbot", 1), ("2024-01-02", "GPTBot", 1)}
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.json").write_text("\n".join(json.dumps({"source": "s", "dedupe_key": k, "ts": "2024-01-01T00:00:00"}) for k in ("a", "b", "a")))
    q = jobs.stream_new_events(spark.readStream.schema("source string, dedupe_key string, ts timestamp").json(str(tmp_path / "ev"))).writeStream.format("memory").queryName("ev").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("ev").count() == 2
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text("\n".join(json.dumps({"key": k, "run": r, "present": p}) for k, r, p in (("x", 1, True), ("x", 2, False), ("x", 3, False), ("y", 1, False), ("y", 2, True))))
    q = jobs.stream_missing_streak(spark.readStream.schema("key string, run bigint, present boolean").json(str(tmp_path / "runs"))).writeStream.format("memory").queryName("st").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.streak, r.state) for r in spark.table("st").collect()} == {("x", 2, "lost"), ("y", 0, "kept")}
    store = {}
    merge = jobs.stream_history(lambda: spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), lambda df: store.update(rows=sorted(map(tuple, df.collect()))), ["k"], ["v"])
    merge(spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), 0)
    assert store["rows"] == [("a", 1), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("n", [1, 3])
def test_paths_of_aliases_end(spark, n):
    aliases = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)] + [(str(n), "0")], "src string, dst string")
    keys = spark.createDataFrame([("0",), ("z",)], "key string")
    got = {r.key: r.target for r in graph.resolve_aliases(keys, aliases).collect()}
    assert got == {"0": str(n), "z": "z"}
