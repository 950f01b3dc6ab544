"""Several sites in one table: their pages, rules and limits never meet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import checks, diff, graph, logs, pages, prefixes, similar, texts, trends


def edges(spark, rows):
    return spark.createDataFrame(rows, "site string, src string, dst string")


def test_link_graphs(spark):
    links = edges(spark, [("a", "h", "x"), ("a", "x", "y"), ("b", "h", "y"), ("b", "x", "z")])
    roots = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "site string, node string")
    got = {(r.site, r.node): r.depth for r in graph.link_depths(links, roots).collect()}
    assert got == {("a", "h"): 0, ("a", "x"): 1, ("a", "y"): 2, ("b", "h"): 0, ("b", "y"): 1, ("c", "h"): None}
    assert {(r.site, r.dst, r.inbound) for r in graph.inbound_counts(links).collect()} == {("a", "x", 1), ("a", "y", 1), ("b", "y", 1), ("b", "z", 1)}
    status = spark.createDataFrame([("a", "y", 404), ("b", "z", 500)], "site string, node string, status int")
    assert {(r.site, r.dst, r.linkers, r.first_linkers) for r in graph.broken_internal_links(links, status).collect()} == {("a", "y", 1, "x"), ("b", "z", 1, "x")}
    aliases = spark.createDataFrame([("a", "x", "z")], "site string, src string, dst string")
    names = spark.createDataFrame([("a", "x"), ("b", "x")], "site string, key string")
    assert {(r.site, r.target) for r in graph.resolve_aliases(names, aliases).collect()} == {("a", "z"), ("b", "x")}
    universe = spark.createDataFrame([("a", "q"), ("a", "x"), ("b", "h"), ("c", "x")], "site string, node string")
    known = universe.withColumn("indexable", F.lit(True))
    depths = graph.link_depths(links, roots).filter("depth is not null")
    assert {(r.site, r.node, r.type) for r in graph.orphan_pages(universe, depths, known).collect()} == {("a", "q", "orphan_page"), ("c", "", "refused")}


def test_robots(spark):
    docs = spark.createDataFrame([("a", "User-agent: GPTBot\nDisallow: /x\n\nUser-agent: *\nDisallow: /"), ("b", "User-agent: *\nDisallow: /y\nAllow: /y/z"), ("c", "User-agent: GPTBot\nDisallow:")], "site string, body string")
    rules = logs.robots_rules(docs)
    urls = spark.createDataFrame([(s, f"https://{s}.x{p}") for s in "abcd" for p in ("/x", "/y", "/y/z")], "site string, url string")
    got = {(r.site, r.url.split(".x")[1]): r.allowed for r in logs.robots_allowed(urls, rules, "GPTBot").collect()}
    assert {k for k, ok in got.items() if not ok} == {("a", "/x"), ("b", "/y")} and len(got) == 12
    other = {(r.site, r.url.split(".x")[1]) for r in logs.robots_allowed(urls, rules, "Other").collect() if not r.allowed}
    assert other == {("a", "/x"), ("a", "/y"), ("a", "/y/z"), ("b", "/y")}
    audit = {(r.site, r.bot): (r.matched, r.root_blocked, r.blocking_rule, r.blocked_patterns, r.severity) for r in logs.crawler_access_audit(rules).collect()}
    assert audit["a", "GPTBot"] == ("exact", False, "", 1, "none") and audit["a", "bingbot"] == ("wildcard", True, "/", 0, "high") and audit["a", "CCBot"][4] == "info"
    assert audit["b", "bingbot"] == ("wildcard", False, "", 1, "medium") and audit["c", "bingbot"][0] == "none" and len(audit) == 3 * len(logs.BOTS)


def test_root_rules(spark):
    body = "User-agent: *\nDisallow: /\nDisallow: /*\nAllow: /$\nDisallow: /p\n"
    row = logs.crawler_access_audit(logs.robots_rules(spark.createDataFrame([("a", body)], "site string, body string"))).filter("bot = 'bingbot'").first()
    assert (row.root_blocked, row.blocked_patterns) == (False, 1)  # Allow wins the tie of two characters


def test_redirects(spark):
    rules = spark.createDataFrame([("a", "/old/*", "/n"), ("b", "/old/1", "/m"), ("a", "/*", "/")], "site string, source string, target string")
    seen = spark.createDataFrame([("a", 1, "/old/1", "/n", 301, ""), ("b", 1, "/old/1", None, 200, ""), ("b", 2, "/old/2", "/q", 301, ""), ("b", 3, "/loop", "/loop", 301, "too_many_redirects")], "site string, fetch_seq int, path string, landing string, status int, error_type string")
    assert {(r.site, r.source): r.state for r in diff.expected_redirects(rules, seen).collect()} == {("a", "/old/*"): "confirmed", ("a", "/*"): "wrong_destination", ("b", "/old/1"): "not_honoured"}
    assert {(r.site, r.path) for r in diff.undeclared_redirects(rules, seen).collect()} == {("b", "/old/2"), ("b", "/loop")}
    old = spark.createDataFrame([("a", "/old/9"), ("b", "/old/9"), ("b", "/old/2"), ("b", "/loop")], "site string, path string")
    cover = diff.migration_coverage(old, seen, rules)
    assert {(r.site, r.path): r.state for r in cover.collect()} == {("a", "/old/9"): "covered_by_rule", ("b", "/old/9"): "unreachable", ("b", "/old/2"): "covered_live", ("b", "/loop"): "redirect_loops"}
    assert {(r.site, r.missing, r.launch_blocker) for r in diff.migration_summary(cover).collect()} == {("a", 0, False), ("b", 2, True)}


def test_trends(spark):
    rows = spark.createDataFrame([("a", "q", "/1", dt.date(2024, 1, 1), 5, 50, 3.0), ("b", "q", "/2", dt.date(2024, 1, 1), 9, 90, 3.0), ("b", "t", "/2", dt.date(2024, 1, 2), 1, 10, 3.0)], "site string, key string, page string, d date, clicks long, impressions long, position double")
    assert {(r.site, r.key, r.clicks, r.pages) for r in trends.top_queries(rows, 1).collect()} == {("a", "q", 5, "/1"), ("b", "q", 9, "/2")}
    assert {(r.site, r.key) for r in trends.select_tracked_keys(rows, ["T"], 20).collect()} == {("a", "q"), ("b", "t")}
    assert {(r.site, str(r.d)[-2:], r.clicks) for r in trends.dense_daily_series(rows, "2024-01-01", "2024-01-02").collect()} == {("a", "01", 5), ("a", "02", 0), ("b", "01", 9), ("b", "02", 1)}
    assert trends.weekly_positions(rows).count() == 3
    lost = trends.click_regressions(rows.filter("site = 'a'").withColumn("page", F.lit("/2")), rows.filter("site = 'b'").withColumn("clicks", F.lit(40)).limit(1))
    assert [(r.site, r.before, r.after) for r in lost.collect()] == [("b", 40, 0)]


def test_pages(spark):
    record = "site string, crawl_id string, fetch_seq int, url string, title string, status int, error_type string, content_type string, meta_robots string, x_robots_tag string, canonical string, meta_description string"
    rows = spark.createDataFrame([(s, "c", i, f"https://{s}/p{i}", t, 200, "", "text/html", "", "", "", "d") for s, i, t in (("a", 1, "T"), ("a", 2, "T"), ("a", 3, "U"), ("b", 1, "U"))], record)
    assert {(r.site, r.value, r.pages, r.url[-2:]) for r in pages.duplicate_values(rows).collect()} == {("a", "T", 2, "p1"), ("a", "T", 2, "p2")}
    assert [(r.site, r.url[-2:], r.segment, r.description) for r in pages.page_map(rows, 2).collect()] == [("a", "p1", "p1", "d"), ("a", "p2", "p2", "d"), ("b", "p1", "p1", "d")]
    listed = spark.createDataFrame([("b", "https://b/p1"), ("a", "https://b/p1")], "site string, key string")
    got = checks.sitemap_mismatch(pages.resolve_url_identity(rows), listed).collect()
    assert {(r.site, r.url[-2:]) for r in got} == {("a", "p1"), ("a", "p2"), ("a", "p3")}


@pytest.mark.parametrize("age", [0, 3])
def test_baselines_against_a_plain_loop(spark, age):
    rows = [(f"s{i % 3}", f"c{i:03}", dt.date(2024, 1, 1) + dt.timedelta(days=(i * 7) % 23), None if i % 11 == 0 else 100 * (i % 2), i % 5 == 0) for i in range(80)]
    got = {(r.site, r.crawl_id): (r.baseline, r.reason) for r in diff.find_baseline(spark.createDataFrame(rows, "site string, crawl_id string, finished_at date, max_pages int, truncated boolean"), age).collect()}
    for site, crawl_id, at, limit, cut in rows:
        earlier = [r for r in rows if r[0] == site and r[2] < at]
        same = [r for r in earlier if limit is not None and r[3] == limit]
        whole = [r for r in same if not r[4]]
        fit = [r for r in whole if (at - r[2]).days >= age and not cut]
        reason = "" if fit else "current_truncated" if cut else "no_earlier_snapshot" if not earlier else "other_page_limit" if not same else "baseline_truncated" if not whole else "too_recent"
        assert got[site, crawl_id] == (max(fit, key=lambda r: (r[2], r[1]))[1] if fit else None, reason)


def test_group_ranks(spark):
    rows = spark.createDataFrame([(i % 10 == 0, (i * 37) % 101, i) for i in range(100)], "g boolean, v int, i int")
    got = pages.with_group_rank(rows, ["g"], "v").collect()
    for g in (True, False):
        own = sorted((r.v, r.i) for r in got if r.g == g)
        assert [r.rank for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(1, len(own) + 1))


def test_cosine_pairs_against_all(spark):
    import itertools
    import math
    import random

    r = random.Random(1)
    sides = [{k: {w: r.randint(1, 3) for w in r.sample("common words of all kinds that some titles share with others in part".split(), r.randint(1, 6))} for k in range(40)} for _ in range(2)]
    left, right = (spark.createDataFrame([(k, w, n) for k, v in s.items() for w, n in v.items()], f"{name} int, term string, w int") for name, s in zip("ab", sides))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for least in (0.08, 0.6):
        want = {(a, b) for a, b in itertools.product(*sides) if (dot := sum(n * sides[1][b].get(w, 0) for w, n in sides[0][a].items())) and dot / norm(sides[0][a]) / norm(sides[1][b]) >= least}
        assert {(p.a, p.b) for p in similar.cosine_pairs(left, right, least).collect()} == want


def test_staleness_context(spark):
    text = "x" * 80 + " Since 2019 the tool v 2.3.1 ran. Gadget 4.5 at $9 each. last year, (C) 2031 © 2020."
    got = {(r.kind, r.phrase): r.context for r in texts.staleness_phrases(spark.createDataFrame([(1, text), (2, None)], "page_id int, text string"), 2026).collect()}
    assert set(got) == {("hardcoded_year", "2019"), ("hardcoded_year", "2020"), ("version_reference", "v 2.3.1"), ("relative_time_phrase", "last year"), ("copyright_year", "© 2020")}
    at = text.index("2019")
    assert got["hardcoded_year", "2019"] == text[at - 60 : at + 64].strip()


def test_mount_nodes(spark):
    rows = [("bare", '<div id="root"></div>', 5), ("full", "<div id=root>" + "<p>word word</p>" * 8 + "</div>", 16), ("nested", '<div id="app"><div>a b</div><div>' + "w " * 20 + "</div></div>", 22), ("none", "<div id=rooted></div>", 3), ("script", '<div id="app"><script>' + "w " * 20 + "</script></div>", 4)]
    got = checks.js_dependency(spark.createDataFrame(rows, "url string, html string, word_count int")).collect()
    assert {r.url for r in got} == {"bare", "script"}


def test_prefix_rules_against_all_pairs(spark):
    """No site: patterns of every kind meet all paths that they begin, no plan joins on one key or every pair."""
    import random
    import re

    r = random.Random(9)
    part = lambda: "".join(r.choice("ab/") for _ in range(r.randint(0, 40)))
    paths = sorted({"/" + part() for _ in range(300)})
    patterns = ["/", "*", "/*", "/a$", "*b$", "/a*b", "/$", "", "/ab/", "/a.b"] + ["/" + part()[: r.randint(0, 12)] + r.choice(["", "*", "$"]) for _ in range(60)]
    rules = [(r.choice(["allow", "disallow"]), p) for p in patterns]
    frame = spark.createDataFrame([("*", k, p) for k, p in rules], "agent string, kind string, pattern string")
    urls = spark.createDataFrame([(f"https://x{p}",) for p in paths], "url string")
    got = {x.url[9:]: x.allowed for x in logs.robots_allowed(urls, frame, "Bot").collect()}

    def fits(pattern, path):
        regex = ".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + ("$" if pattern.endswith("$") else "")
        return pattern != "" and re.match(regex, path)

    for path in paths:
        best = max(((len(p), k == "allow") for k, p in rules if fits(p, path)), default=(0, True))
        assert got[path] == best[1], path
    plan = prefixes.prefix_hits(urls.withColumnRenamed("url", "path"), frame.withColumnRenamed("pattern", "prefix"), [])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    redirects = spark.createDataFrame([(p, "/t") for p in ("/", "/*", "/a*", "/b/:x", "/ab/ab*", "*", "/" + "ab" * 20 + "*")], "source string, target string")
    seen = spark.createDataFrame([(i, p, "/t" if i % 2 else None, 301) for i, p in enumerate([*paths, "/" + "ab" * 30])], "fetch_seq int, path string, landing string, status int")
    rows = seen.collect()
    for x in diff.expected_redirects(redirects, seen).collect():
        open_ = re.search("[*:]", x.source)
        prefix = re.split("[*:]", x.source)[0]
        fit = [p for p in rows if (p.path == x.source if not open_ else prefix != "" and p.path.startswith(prefix))]
        assert x.path == (min(fit, key=lambda p: p.fetch_seq).path if fit else None)


def test_rounds_move_their_frontier_only(spark, monkeypatch):
    """Depths against a plain search, over several buckets; neither links nor reached nodes are shuffled in a round."""
    import random
    from collections import deque

    from sitegauge.sources.tables import scratch_path

    r = random.Random(1)
    pairs = [(a, r.randrange(max(0, a - 80), min(400, a + 80))) for a in range(400) for _ in range(2)]
    links, roots = spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(0,), (9999,)], "node int")
    monkeypatch.setattr(graph, "BUCKET", 200)
    want, queue, out = {0: 0}, deque([0]), {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    while queue:
        node = queue.popleft()
        for b in out.get(node, []):
            if b not in want:
                want[b] = want[node] + 1
                queue.append(b)
    assert {x.node: x.depth for x in graph.link_depths(links, roots).collect()} == want | {9999: None}
    graph._bucketed(links.repartition(4, "src"), "links_of_a_round", scratch_path(spark, "t"), 4, ["src"])
    graph._bucketed(roots.withColumn("depth", F.lit(0)).repartition(4, "node"), "nodes_of_a_round", scratch_path(spark, "t"), 4, ["node"], "depth")
    try:
        plan = graph.next_nodes(spark.table("links_of_a_round"), spark.table("nodes_of_a_round"), 1, [], 4)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(moved) <= 2 and "Bucketed: false" not in plan, plan  # the frontier and its finds
    finally:
        for name in ("links_of_a_round", "nodes_of_a_round"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_robots_files_of_one_site_are_read_apart(spark):
    body = "Sitemap: https://a/s\nUser-agent: X\nUser-agent: Y\nCrawl-delay: 2\nDisallow: /{0}\nUser-agent: *\nDisallow: /all{0}"
    docs = spark.createDataFrame([("a", body.format(1)), ("a", body.format(2)), ("a", body.format(2)), ("b", "Disallow: /lost\nUser-agent: X")], "site string, body string").repartition(3)
    got = sorted((r.group_id, r.agent, r.kind, r.pattern, r.pos, r.crawl_delay) for r in logs.robots_rules(docs).collect())
    one = lambda n: [(0, "", "sitemap", "https://a/s", 0, None), *[(1, who, *what, 2.0) for who in "xy" for what in (("crawl-delay", "2", 3), ("disallow", f"/{n}", 4))], (2, "*", "disallow", f"/all{n}", 6, None)]
    assert got == sorted(one(1) + one(2) + one(2), key=lambda r: r[:5])


def test_each_address_has_its_answer(spark):
    rules = logs.robots_rules(spark.createDataFrame([("a", "User-agent: *\nDisallow: /x")], "site string, body string"))
    urls = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/x"), ("a", "https://a/y"), ("b", "https://a/x"), ("b", None)], "site string, url string")
    got = sorted((r.site, r.url or "", r.allowed) for r in logs.robots_allowed(urls, rules, "Bot").collect())
    assert got == [("a", "https://a/x", False), ("a", "https://a/x", False), ("a", "https://a/y", True), ("b", "", True), ("b", "https://a/x", True)]


def test_marks_of_prices_can_be_named(spark):
    rows = spark.createDataFrame([(1, "License, Version 2.0.\nOnly $$$ here. We offer Gadget 9.9 price and more than enough words, then Widget 2.3 costs $5")], "page_id int, text string")
    assert {r.phrase for r in texts.staleness_phrases(rows, 2026).collect()} == set()
    assert {r.phrase for r in texts.staleness_phrases(rows, 2026, marks=("gadget 9.9 price",)).collect()} == {"Version 2.0", "Widget 2.3"}
