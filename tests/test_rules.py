"""Rules of pages and texts: plain versions and single cases."""

import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import answers, checks, pages, texts
from sitegauge.sources import vendors


def greedy(candidates, max_links=None):
    """In order of the page: the best target that is left."""
    used, out = set(), []
    for para in sorted({p for p, _, _ in candidates}):
        if max_links is not None and len(out) >= max_links:
            break
        left = [(-score, t) for p, t, score in candidates if p == para and t not in used]
        if left:
            used.add(min(left)[1])
            out.append((para, min(left)[1]))
    return out


@pytest.mark.parametrize("seed,max_links", [(1, None), (2, None), (3, 3), (4, None)])
def test_anchors_are_chosen_as_a_reader_would(spark, monkeypatch, seed, max_links):
    r = random.Random(seed)
    made = {page: [(p, t, round(r.choice([0.2, 0.4, 0.6]), 4)) for p in range(page * 100, page * 100 + 12) for t in range(8) if r.random() < 0.4] for page in (1, 2)}
    made[3] = [(300 + p, t, 0.9 - 0.1 * t) for p in range(9) for t in range(9)]  # each waits for all before
    rows = [(p, t, "some phrase", s) for c in made.values() for p, t, s in c]
    monkeypatch.setattr(texts, "anchor_candidates", lambda *_, **__: spark.createDataFrame(rows, "para_id int, title_id int, phrase string, score double"))
    paragraphs = spark.createDataFrame([(page, p) for page, c in made.items() for p in {x for x, _, _ in c}], "page_id int, para_id int")
    got = sorted((x.page_id, x.para_id, x.title_id) for x in texts.anchor_phrases(paragraphs, None, max_links).collect())
    assert got == sorted((page, p, t) for page, c in made.items() for p, t in greedy(c, max_links))


def test_no_anchors(spark):
    none = spark.createDataFrame([(1, "nothing to see")], "para_id int, text string")
    titles = spark.createDataFrame([(1, "Other things here", "text")], "title_id int, title string, text string")
    assert texts.anchor_phrases(none, titles).collect() == []


def test_statistics_and_sentences(spark):
    docs = spark.createDataFrame([(1, "We paid $25 to $60, 13.6% of 2,000 in 2026; 12 min, 1 in 6. It grew 3 million. \"Fine\" e.g. this. 4k"), (2, None), (3, "")], "doc_id int, text string")
    got = [(x.rank, x.token) for x in texts.doc_statistics(docs).orderBy("rank").collect()]
    assert got == [(1, "$25 to $60"), (2, "3 million"), (3, "13.6%"), (4, "4k")]
    assert [x.sentence for x in texts.doc_sentences(docs).orderBy("pos").collect()] == ["We paid $25 to $60, 13.6% of 2,000 in 2026; 12 min, 1 in 6.", "It grew 3 million.", '"Fine" e.g. this.', "4k"]


def test_site_rules_by_kind(spark):
    kind = "url string, kind string, lang string, meta_robots string, canonical string, json_ld_types array<string>"
    rows = spark.createDataFrame([("https://a/1", "search", "en", "noindex", "", ["Organization", "WebSite"]), ("https://a/2", "home", " ", "index", "https://a/2/", ["Organization", "WebSite", "Blog"]), ("https://a/3", "notfound", "en", "", "", []), ("https://a/4", "author", "en", "noindex", "/4", ["Organization"])], kind)
    got = {(x.url[-1], x.code, x.severity) for x in checks.site_conformance(rows).collect()}
    assert got == {("2", "html-lang", "error"), ("3", "robots-meta", "warn"), ("4", "robots-meta", "error"), ("4", "canonical", "error"), ("4", "jsonld-graph", "error"), ("4", "jsonld-profile", "warn")}
    own = (("home author", "short", "info", "size(json_ld_types) < 3"), (None, "words", "info", "no_such_column > 3"))
    assert [(x.url, x.code) for x in checks.site_conformance(rows, own).collect()] == [("https://a/4", "short")]


def test_assertions_without_a_record_fail(spark):
    pages_ = spark.createDataFrame([("u", " T ", "a  b", "NOINDEX", None)], "url string, title string, text string, meta_robots string, canonical string")
    asked = [("u", "title", "T"), ("u", "text_present", "a b"), ("u", "text_absent", "c"), ("u", "indexable", "false"), ("u", "canonical", "x"), ("u", "header", "x"), ("v", "text_absent", "c"), ("v", "indexable", "true")]
    got = checks.assert_pages(pages_, spark.createDataFrame(asked, "url string, kind string, expected string"))
    assert {(x.url, x.kind): x["pass"] for x in got.collect()} == {("u", "title"): True, ("u", "text_present"): True, ("u", "text_absent"): True, ("u", "indexable"): True, ("u", "canonical"): False, ("u", "header"): False, ("v", "text_absent"): False, ("v", "indexable"): False}
    assert {(x.url, x.failed, x["pass"]) for x in checks.page_verdicts(got).collect()} == {("u", 2, False), ("v", 2, False)}


def test_images_without_alt_count_over_all_pages(spark):
    kind = "url string, status int, error_type string, content_type string, images_missing_alt int, title string"
    rows = [("a", 404, "", "text/html", 5, "t"), ("b", 200, "", "text/html", 2, ""), ("c", 200, "x", "text/html", 0, ""), ("d", 200, "", "application/pdf", 0, "")]
    got = [tuple(x) for x in pages.page_opportunities(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("missing_title_tag", "high", "low", 1, "b"), ("images_missing_alt_text", "low", "medium", 7, "b")]
    assert pages.page_opportunities(spark.createDataFrame(rows[:1], kind)).collect() == []


@pytest.mark.parametrize("n,named,verdict", [(0, 0, "no-data"), (9, 9, "thin-sample"), (30, 0, "thin-sample"), (30, 4, "thin-sample"), (30, 20, "sampled-absence")])
def test_verdicts(spark, n, named, verdict):
    rows = [(1, i, 0, e, e == "rival" and i < named, 0, -1.0) for i in range(n) for e in ("brand", "rival")]
    mentions = spark.createDataFrame(rows, "run int, conv_id int, turn int, entity string, mentioned boolean, n int, first_position double")
    got = answers.measurement_verdict(mentions, "brand", runs=spark.createDataFrame([(1,)], "run int")).first()
    assert (got.verdict, got.n, got.informative) == (verdict, n, named)
    if n:
        assert answers.measurement_verdict(mentions.filter("entity = 'brand'"), "brand").first().verdict == "no-competitors"


def test_social_posts_of_all_platforms(spark):
    rows = {
        "reddit": '{"id": "1", "author": {"name": "me"}, "subreddit": "s", "permalink": "/r/s/1", "created": "1700000000"}', "tiktok": '{"aweme_info": {"aweme_id": "1", "desc": "t", "author": {"nickname": "me"}, "statistics": {"digg_count": 3}, "create_time": 1700000000}}',
        "youtube": '{"id": "1", "channel": {"handle": "me"}, "publishedTimeText": "2 days ago"}', "twitter": '{"id_str": "1", "user": {"username": "me"}, "created_at": "Tue Nov 14"}', "instagram": '{"shortcode": "1", "owner": {"username": "me"}, "caption": "t", "taken_at": 1700000000}', "google": '{"url": "u", "title": "t"}',
    }
    got = {k: vendors.normalize_social_posts(spark.createDataFrame([(j,)], "json string"), k).first() for k, j in rows.items()}
    assert {k: (x.id, x.author, x.created_at) for k, x in got.items()} == {
        "reddit": ("1", "me", "2023-11-14T22:13:20+00:00"), "tiktok": ("1", "me", "2023-11-14T22:13:20+00:00"), "youtube": ("1", "me", "2 days ago"), "twitter": ("1", "me", "Tue Nov 14"), "instagram": ("1", "me", "2023-11-14T22:13:20+00:00"), "google": (None, None, None),
    }
    assert (got["reddit"].url, got["reddit"].community, got["tiktok"].score) == ("https://www.reddit.com/r/s/1", "r/s", 3)


def test_quote_trail(spark):
    points = spark.createDataFrame([(1, 2, "B  b!"), (1, 1, "a A"), (1, 3, "not there"), (9, 1, "a a"), (1, 4, "")], "source_id int, pos int, quote string")
    sources = spark.createDataFrame([(1, "u", "t", "x a a; b, B b y"), (2, "v", "t", None)], "source_id int, url string, title string, body string")
    assert {(x.source_id, x.rank, x.quote) for x in texts.quote_trail(points, sources).collect()} == {(1, 1, "a A"), (1, 2, "B  b!"), (2, None, None)}
    assert {(x.source_id, x.kept, x.dropped) for x in texts.verify_quotes(points, sources).collect()} == {(1, 2, 2), (9, 0, 1)}


def test_times_of_posts_beyond_the_year_9999(spark):
    rows = spark.createDataFrame([(f'{{"id": "1", "created_utc": {s}}}',) for s in (253402300799, 253402300800, 5000000 * 86400)], "json string")
    got = [x.created_at for x in vendors.normalize_social_posts(rows, "reddit").collect()]
    assert got == ["9999-12-31T23:59:59+00:00", "10000-01-01T00:00:00+00:00", "15659-07-15T00:00:00+00:00"]


def test_equal_samples_keep_their_own_citations(spark):
    cited = lambda *urls: '{"annotations": [' + ", ".join(f'{{"type": "url_citation", "url": "{u}", "title": "T"}}' for u in urls) + "]}"
    rows = spark.createDataFrame([("r", "p", "v", 1, cited("https://A/", "https://b/", "https://a/", "")), ("r", "p", "v", 1, cited("https://a/")), ("r", "q", "v", 1, "{}")], "run string, prompt string, provider string, sample int, json string")
    got = sorted((x.prompt, x.key, x.url or "", x.title or "") for x in vendors.flatten_ai_samples(rows).collect())
    assert got == [("p", "https://a/", "https://A/", "T"), ("p", "https://a/", "https://a/", "T"), ("p", "https://b/", "https://b/", "T"), ("p", "t", "", "T"), ("q", "", "", "")]


def test_pages_of_one_address_are_told_apart(spark):
    words = lambda *rows: spark.createDataFrame(list(rows), "page_id int, url string, words int")
    got = {(x.page_id, x.raw_words, x.rendered_words) for x in checks.render_gap(words((1, "u", 10), (2, "u", 20), (3, "v", 5)), words((1, "u", 300), (2, "u", 20), (3, "v", 5))).collect()}
    assert got == {(1, 10, 300), (2, 20, 20), (3, 5, 5)}


def test_fetches_of_pages_of_one_address_are_told_apart(spark):
    rows = [(p, "u", role, status, "h", w) for p, last, w in ((1, 200, 100), (2, 500, 100), (3, 200, 10)) for role, status, w in (("human_before", 200, 100), ("human_after", last, 100), ("bot", 200, w))]
    got = {x.page_id: x.state for x in checks.served_content_divergence(spark.createDataFrame(rows, "page_id int, url string, role string, status int, hash string, words int")).collect()}
    assert got == {1: "same", 2: "not_checked", 3: "diverges"}


def test_assertions_meet_each_record_of_their_address(spark):
    pages_ = spark.createDataFrame([(1, "u", "T", True), (2, "u", "T", False), (3, "u", "X", True)], "page_id int, url string, title string, fetched boolean")
    asked = spark.createDataFrame([("u", "title", None, "T"), ("u", "robots_allowed", "b", "false"), ("v", "title", None, "T")], "url string, kind string, name string, expected string")
    allowed = spark.createDataFrame([(1, "u", "b", True), (2, "u", "b", False), (3, "u", "b", False)], "page_id int, url string, agent string, allowed boolean")
    got = sorted((x.url, x.kind, x["pass"]) for x in checks.assert_pages(pages_, asked, allowed).collect())
    assert got == [("u", "robots_allowed", False), ("u", "robots_allowed", False), ("u", "robots_allowed", True), ("u", "title", False), ("u", "title", False), ("u", "title", True), ("v", "title", False)]


def test_a_title_is_cut_into_words_once(spark):
    """Not again for each of its runs: that would take the square of a long title's length."""
    paragraphs = spark.createDataFrame([(1, "We know the quick brown fox well, and [quick brown](x) too.")], "para_id int, text string")
    titles = spark.createDataFrame([(1, "Quick brown fox", "the quick brown fox"), (2, "word " * 3000 + "know the quick", "we know the quick brown fox"), (3, None, None)], "title_id int, title string, text string")
    found = texts.anchor_candidates(paragraphs, titles)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    runs = [line for line in plan.splitlines() if "slice(" in line]
    assert runs and not any("regexp_extract_all" in line for line in runs)
    assert {(r.title_id, r.phrase) for r in found.collect()} == {(1, "quick brown fox"), (2, "know the quick")}
