"""Run over run: votes, streaks, regressions of several snapshots, changes of texts, gates of traffic, last keys."""

import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import answers, diff, trends
from sitegauge.streaming import jobs

SAMPLES = "run_date string, prompt_id int, provider string, sample_id int, outcome string, citations array<struct<url:string,title:string>>"


def votes(spark, *samples, target="www.Shop.example"):
    rows = spark.createDataFrame([("r", 1, "p", i, outcome, cited) for i, (outcome, cited) in enumerate(samples)], SAMPLES)
    return answers.vote_samples(rows, target).first()


@pytest.mark.parametrize(
    "outcomes,state,valid",
    [
        (["cited", "not_configured", "not_configured"], "cited", 1), (["not_configured"] * 2, "not_configured", 0), (["error", "not_configured"], "error", 0), (["error"] * 2, "error", 0),
        (["not_cited", "error"], "not_cited", 1), (["cited", "not_cited", "not_cited"], "mixed", 3), (["cited", "not_cited"], "cited", 2), (["cited", "cited", "not_cited", "not_cited", "not_cited"], "mixed", 5),
    ],
)
def test_votes(spark, outcomes, state, valid):
    got = votes(spark, *[(o, None) for o in outcomes])
    assert (got.state, got.valid, got.citation_urls) == (state, valid, [])


def test_citations_are_united_by_identity(spark):
    redirect = "https://redirect.example/1"
    got = votes(
        spark,
        ("error", [("https://shop.example/lost", None)]), ("not_configured", [("https://shop.example/off", None)]), ("not_cited", [("https://else.example/", "Else"), (" http://www.shop.example/a/ ", "A")]),
        ("cited", [("https://shop.example/a?utm_source=x", "later"), ("https://shop.example/b", ""), (redirect, "blog.shop.example"), (redirect + "2", "Blog.Shop.example"), (None, None), ("https://notshop.example/", "notshop.example")]), ("cited", None),
    )
    assert got.citation_urls == sorted(["http://www.shop.example/a/", "https://shop.example/b", "blog.shop.example", "Blog.Shop.example"])
    assert (got.valid, got.cited, got.errors, got.state) == (3, 2, 1, "cited")


def test_missing_streaks(spark):
    r = random.Random(2)
    runs = {("a" if k % 2 else "b", k, n) for k in range(30) for n in range(12) if r.random() < 0.3}
    got = {(x.site, x.key): x.streak for x in diff.missing_streaks(spark.createDataFrame(sorted(runs) * 2, "site string, key int, run int")).collect()}
    for site, key in {(s, k) for s, k, _ in runs}:
        last = max(n for s, k, n in runs if (s, k) == (site, key))
        assert got[site, key] == len({n for s, _, n in runs if s == site and n > last})
    plan = diff.missing_streaks(spark.createDataFrame(sorted(runs), "s string, key int, run int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "strategy=broadcast" not in plan


def test_regressions_of_a_batch_in_one_job(spark):
    """Three snapshots of one site and two of another; each is held against its own baseline."""
    kind = "crawl_id string, key string, url string, status int, error_type string, meta_robots string, x_robots_tag string, canonical string"
    crawls = {"a1": (200, ""), "a2": (500, ""), "a3": (500, "noindex"), "b1": (200, ""), "b2": (404, "")}
    pages = spark.createDataFrame([(c, "k", f"https://{c[0]}/", s, "", m, "", "") for c, (s, m) in crawls.items()], kind)
    meta = spark.createDataFrame([(c[0], c, f"2026-01-0{c[1]}", 10, False) for c in crawls], "site string, crawl_id string, finished_at string, max_pages int, truncated boolean").withColumn("finished_at", F.to_date("finished_at"))
    written = []
    jobs.stream_page_regressions(lambda: pages, lambda: meta, written.append)(meta.filter("crawl_id <> 'b1'"), 0)
    assert len(written) == 1
    assert sorted((r.crawl_id, r.url, r.type) for r in written[0].collect()) == [("a2", "https://a/", "status_code_regression"), ("a3", "https://a/", "new_noindex"), ("b2", "https://b/", "status_code_regression")]


def test_text_changes_keep_a_bounded_list(spark):
    old, new = ". ".join(f"s{i}" for i in range(100)), ". ".join(f"n{i}" for i in range(100)) + ". n5. s7"
    both = [spark.createDataFrame([(1, t), (2, "same. text"), (3, None)], "doc_id int, text string") for t in (old, new)]
    got = diff.text_changes(*both, most=40).collect()
    assert len(got) == 1 and (got[0].added, got[0].removed) == (101, 99)
    assert got[0].added_sentences == [f"n{i}" for i in range(40)] and got[0].removed_sentences == [f"s{i}" for i in range(41) if i != 7]


GOOD = {"property": "p", "timezone": "UTC", "exporter": "e", "site_url": "https://a/", "complete": True, "sampled": False, "thresholded": False, "synthetic": False}
TRAFFIC = "d string, page string, source string, medium string, sessions double, key_events double"


@pytest.fixture
def traffic(spark):
    def make(*rows):
        return spark.createDataFrame([("2026-01-05", "/a", "google", "organic", 1.0, 0.0), *rows], TRAFFIC).withColumn("d", F.to_date("d"))

    return make


@pytest.mark.parametrize(
    "row,rule",
    [
        (("2026-02-09", "/b", "s", "m", 1.0, 1.0), "outside_window"), ((None, "/b", "s", "m", 1.0, 1.0), "outside_window"), (("2026-01-05", "//b", "s", "m", 1.0, 1.0), "page_not_relative"), (("2026-01-05", "https://b", "s", "m", 1.0, 1.0), "page_not_relative"),
        (("2026-01-05", "/a", "google", "organic", 2.0, 1.0), "duplicate_key"), (("2026-01-05", "/b", "s", "m", -1.0, 1.0), "negative_metric"), (("2026-01-05", "/b", "s", "m", float("nan"), 1.0), "not_finite_metric"),
        (("2026-01-05", "/b", "s", "m", 1.0, float("inf")), "not_finite_metric"), (("2026-01-05", "/b", "s", "m", None, 1.0), "not_finite_metric"),
    ],
)
def test_rows_that_stop_a_job(traffic, row, rule):
    with pytest.raises(ValueError, match=rf"^traffic refused: {rule}=1$"):
        trends.accepted_traffic(traffic(row), "2026-01-01", "2026-01-28", GOOD)


@pytest.mark.parametrize("change,rule", [({"complete": False}, "incomplete"), ({"sampled": True}, "sampled"), ({"thresholded": True}, "thresholded"), ({"synthetic": None}, "synthetic_unknown"), ({"timezone": " "}, "no_timezone")])
def test_exports_that_stop_a_job(traffic, change, rule):
    with pytest.raises(ValueError, match=f"{rule}=1"):
        trends.accepted_traffic(traffic(), "2026-01-01", "2026-01-28", GOOD | change)


def test_traffic_that_is_accepted(traffic):
    rows = traffic()
    assert trends.accepted_traffic(rows, "2026-01-01", "2026-01-28", GOOD, "2026-01-31") is rows
    with pytest.raises(ValueError, match="window_too_recent=1"):
        trends.accepted_traffic(rows, "2026-01-01", "2026-01-28", GOOD, "2026-01-30")


@pytest.mark.parametrize(
    "before,after,deployed",
    [
        (("2026-01-01", "2026-01-14"), ("2026-01-22", "2026-02-11"), None), (("2026-01-01", "2026-01-07"), ("2026-01-15", "2026-01-21"), None), (("2026-01-01", "2026-01-15"), ("2026-01-22", "2026-02-05"), None),
        (("2026-01-01", "2026-01-14"), ("2026-01-23", "2026-02-05"), None), (("2026-01-01", "2026-01-14"), ("2026-01-22", "2026-02-04"), "2026-01-14"), (("2026-01-01", "2026-01-14"), ("2026-01-22", "2026-02-04"), "2026-01-22"), (("2026-01-22", "2026-02-04"), ("2026-01-01", "2026-01-14"), None),
    ],
)
def test_windows_that_are_refused(before, after, deployed):
    with pytest.raises(ValueError, match="windows refused"):
        trends.comparable_windows(before, after, deployed)


def test_comparison(traffic):
    trends.comparable_windows(("2026-01-01", "2026-01-14"), ("2026-01-22", "2026-02-04"), "2026-01-18")
    with pytest.raises(ValueError, match="property, filters"):
        trends.comparable_exports(GOOD, GOOD | {"property": "q", "filters": "x"})
    rows = traffic(("2026-01-06", "/a?x=1", "google", "organic", 150.0, 0.0), ("2026-01-23", "/a", "google", "organic", 200.0, 0.0), ("2026-01-06", "/c", "google", "organic", 10.0, 0.0), ("2026-01-23", "/c", "google", "organic", 30.0, 0.0), ("2026-01-23", "/a", "chatgpt.com", "referral", 100.0, 0.0), ("2026-01-06", "/a", "x", "y", 400.0, 0.0), ("2026-01-23", "/a", "x", "y", 99.0, 0.0))
    got = {r.channel: (r.delta, r.diff_in_diff, r.decision) for r in trends.traffic_comparison(rows, ("2026-01-01", "2026-01-14"), ("2026-01-22", "2026-02-04"), F.when(F.col("page") == "/a", "page").otherwise("control")).collect()}
    assert got == {"google_organic": (49.0, 29.0, "review"), "chatgpt_referral": (100.0, 100.0, "new"), "other": (-301.0, -301.0, "insufficient")}


def test_last_keys(spark):
    """A key that comes back after others have filled the memory is new again."""
    kind, state, new = "source string, dedupe_key string, batch bigint, place bigint", [spark.createDataFrame([], "source string, dedupe_key string, batch bigint, place bigint")], []

    def write(found, kept):
        new.append([(r.source, r.dedupe_key) for r in found.orderBy("source", "ts").collect()])
        state.append(spark.createDataFrame(kept.collect(), kind))

    pick = jobs.stream_last_keys(lambda: state[-1], write, keep=3)
    r, seen = random.Random(4), {"s": [], "t": []}
    for n in range(5):
        batch = [(s, f"k{r.randint(0, 6)}", i) for i, s in enumerate(r.choices("st", k=5))]
        pick(spark.createDataFrame(batch, "source string, dedupe_key string, ts bigint").withColumn("ts", F.timestamp_seconds("ts")), n)
        want = []
        for s in "st":
            fresh = [k for k in dict.fromkeys(k for x, k, _ in batch if x == s) if k not in seen[s]]
            seen[s] = (seen[s] + fresh)[-3:]
            want += [(s, k) for k in fresh]
        assert new[-1] == want
