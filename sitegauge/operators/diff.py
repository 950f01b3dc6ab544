"""What changed between two crawls, backlink runs or answer runs; as-of baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pages import findings, is_indexable, is_noindex
from ..functions.sites import keys
from ..functions.urls import host_key, url_key
from .graph import first_joined
from .prefixes import prefix_hits


def find_baseline(meta: DataFrame, min_age_days: int = 0) -> DataFrame:
    """As-of join: for each snapshot the newest earlier one of the site with the same page limit, neither cut
    off, at least ``min_age_days`` older; else the reason for the refusal. Frames over the site's snapshots in
    order of time, so the work grows with their number."""
    at, day = F.unix_micros(F.col("finished_at").cast("timestamp")), F.datediff("finished_at", F.lit("1970-01-01").cast("date"))
    rows = meta.withColumn("_at", at).withColumn("_day", day)
    before = Window.partitionBy("site").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("site", "max_pages").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    old = same if min_age_days <= 0 else Window.partitionBy("site", "max_pages").orderBy("_day").rangeBetween(Window.unboundedPreceding, -min_age_days)
    limited = F.col("max_pages").isNotNull()
    rows = rows.withColumn("_n", F.count("_at").over(before)).withColumn("_same", F.when(limited, F.count("_at").over(same)).otherwise(0)).withColumn("_whole", F.when(limited, F.count(F.when(~F.col("truncated"), F.col("_at"))).over(same)).otherwise(0))
    best = F.max(F.when(~F.col("truncated"), F.struct("finished_at", "crawl_id"))).over(old)
    rows = rows.withColumn("baseline", F.when(~F.col("truncated") & limited, best["crawl_id"]))
    reason = F.when(F.col("baseline").isNotNull(), "").when(F.col("truncated"), "current_truncated").when(F.col("_n") == 0, "no_earlier_snapshot").when(F.col("_same") == 0, "other_page_limit").when(F.col("_whole") == 0, "baseline_truncated").otherwise("too_recent")
    return rows.select("site", "crawl_id", "baseline", reason.alias("reason"))


def latest_snapshot(meta: DataFrame, now: Column, max_age_days: int, min_pages: int) -> DataFrame:
    ok = meta.filter((F.datediff(now, "finished_at") <= max_age_days) & (F.col("pages_crawled") >= min_pages))
    return ok.groupBy("site").agg(F.max_by("crawl_id", F.struct("finished_at", "crawl_id")).alias("crawl_id"))


def complete_snapshots(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """A snapshot without provenance is a fragment and stays invisible."""
    return pages.join(meta.select("crawl_id"), "crawl_id", "left_semi")


def paired(prev: DataFrame, cur: DataFrame, columns: list[str], how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    by = [*keys(prev, cur), *more, "key"]
    p = prev.select(*by, *[F.col(c).alias(f"p_{c}") for c in columns])
    return cur.select(*by, *columns).join(p, by, how)


_FIELDS = ["url", "status", "error_type", "meta_robots", "x_robots_tag", "canonical"]


def crawl_regressions(prev: DataFrame, cur: DataFrame, pair: tuple[str, ...] = ()) -> DataFrame:
    """What got worse on pages of both crawls (keyed by ``key``); ``pair`` are the columns that tell several
    pairs of crawls apart, equal on both sides."""
    own = (*keys(prev, cur), *pair)
    both = paired(prev.withColumn("noindex", is_noindex()), cur.withColumn("noindex", is_noindex()), [*_FIELDS, "noindex"], more=pair)
    was_ok = (F.col("p_status") == 200) & (F.col("p_error_type") == "")
    old, new = F.coalesce("p_canonical", F.lit("")), F.coalesce("canonical", F.lit(""))
    cross = (new != "") & (host_key(new) != host_key("url"))
    failed = F.col("error_type") != ""
    return findings(
        both.select(*own, *[c for c in both.columns if c not in own]),
        (~F.col("p_noindex") & F.col("noindex"), "new_noindex", "critical", F.lit("")),
        (was_ok & failed, "fetch_error", "medium", F.col("error_type")),
        (was_ok & ~failed & (F.col("status") != 200), "status_code_regression", F.when(F.col("status") >= 500, "critical").otherwise("high"), F.col("status")),
        ((old != new) & cross, "cross_domain_canonical", "critical", new),
        ((old != new) & ~cross & (old != "") & (new == ""), "canonical_removed", "medium", old),
        ((old != new) & ~cross & (old != "") & (new != "") & (url_key(old) != url_key(new)), "canonical_changed", "medium", new),
        keep=(*own, "url"),
    )


def snapshot_regressions(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """``crawl_regressions`` of all ``pairs(crawl_id, baseline)`` at once: each pair is a key that its two snapshots of
    ``pages`` (one row for each crawl and key) take on, so one snapshot may serve several pairs."""
    pages = pages.drop("site")  # a crawl is of one site
    cur = pages.join(pairs.select("crawl_id"), "crawl_id")
    prev = pages.withColumnRenamed("crawl_id", "baseline").join(pairs.select("crawl_id", "baseline"), "baseline").drop("baseline")
    return crawl_regressions(prev, cur, ("crawl_id",))


def pages_disappeared(prev: DataFrame, cur: DataFrame, truncated: bool = False) -> DataFrame:
    """Indexable before, absent now. Nothing is said if either crawl was cut off."""
    by = keys(prev, cur)
    gone = prev.filter(is_indexable()).join(cur.select(*by, "key"), [*by, "key"], "left_anti").select(*by, "url", F.lit("page_disappeared").alias("type"), F.lit("high").alias("severity"))
    return gone.limit(0) if truncated else gone


def content_changed(prev: DataFrame, cur: DataFrame, column: str = "content_version") -> DataFrame:
    both = paired(prev, cur, ["url", "status", column])
    return both.filter((F.col("status") == 200) & (F.col("p_status") == 200) & (F.col(column) != F.col(f"p_{column}"))).select(*keys(prev, cur), "key", "url")


def newly_broken_links(prev_edges: DataFrame, cur_edges: DataFrame, status: DataFrame) -> DataFrame:
    """Links that are new on a page and lead to a broken target; the first five listed."""
    by = keys(prev_edges, cur_edges, status)
    bad = status.filter("status >= 400 and error_type = ''").select(*by, F.col("node").alias("dst"))
    rows = cur_edges.join(prev_edges, [*by, "src", "dst"], "left_anti").join(bad, [*by, "dst"], "left_semi")
    return rows.groupBy(*by, "src").agg(F.count("*").alias("n")).join(first_joined(rows.select(*by, "src", "dst").distinct(), [*by, "src"], "dst", 5, "targets"), [*by, "src"])


def new_redirects(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Answered directly before, redirects now; high if it lands on another host."""
    both = paired(prev, cur, ["url", "final_url", "status"])
    direct = (F.col("p_status") == 200) & (url_key("p_url") == url_key("p_final_url"))
    moved = both.filter(direct & (url_key("url") != url_key("final_url")))
    return moved.select(*keys(prev, cur), "url", "final_url", F.when(host_key("url") != host_key("final_url"), "high").otherwise("medium").alias("severity"))


def backlink_diff(prev: DataFrame, cur: DataFrame, streaks: DataFrame, prev_run_date: Column) -> DataFrame:
    """State of each link ``(url_from, url_to)``: new, appeared_not_recent, lost, possibly_lost, kept; with its streak."""
    keys = ["url_from", "url_to"]
    one = prev.groupBy(*keys).agg(F.lit(True).alias("before"))
    two = cur.groupBy(*keys).agg(F.bool_and(~F.col("is_lost")).alias("live"), F.bool_or("is_lost").alias("flagged"), F.min("first_seen").alias("first_seen"))
    rows = one.join(two, keys, "full_outer").join(streaks, keys, "full_outer")
    before, live, flagged = (F.coalesce(c, F.lit(False)) for c in ("before", "live", "flagged"))
    streak = F.when(live, 0).otherwise(F.coalesce("streak", F.lit(0)) + 1).cast("int")
    known = before | (F.coalesce("streak", F.lit(0)) > 0)
    state = (
        F.when(live & ~known & (F.col("first_seen") >= F.date_sub(prev_run_date, 7)), "new").when(live & ~known, "appeared_not_recent").when(live, "kept")
        .when(flagged | (streak >= 2), "lost").otherwise("possibly_lost")
    )
    return rows.select(*keys, state.alias("state"), streak.alias("streak"))


def referring_domain_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    p, c = prev.select("source_domain").distinct(), cur.filter("not is_lost").select("source_domain").distinct()
    return c.join(p, "source_domain", "left_anti").withColumn("change", F.lit("new")).unionByName(p.join(c, "source_domain", "left_anti").withColumn("change", F.lit("lost")))


def missing_streaks(runs: DataFrame) -> DataFrame:
    """Runs in a row, up to the last, in which a key of ``(key, run)`` has been absent: the number of runs (of its site)
    after the last one that saw it. Runs are ranked by themselves, then met by equality."""
    by = keys(runs)
    numbers = runs.select(*by, "run").distinct()
    later = numbers.select(*by, F.col("run").alias("seen"), (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("run"))) - 1).cast("bigint").alias("streak"))
    seen = runs.groupBy(*by, "key").agg(F.max("run").alias("seen"))
    return seen.join(later, [*by, "seen"]).select(*by, "key", "streak")


def citation_changes(history: DataFrame) -> DataFrame:
    """State of each (prompt, provider) now against the run before, damped by the one before that."""
    w = Window.partitionBy("prompt_id", "provider").orderBy("run_date")
    rows = history.withColumn("p", F.lag("state", 1).over(w)).withColumn("pp", F.lag("state", 2).over(w)).withColumn("pu", F.lag("urls", 1).over(w))
    s, p, pp = F.col("state"), F.col("p"), F.col("pp")
    cited = s.isin("cited", "mixed")
    change = (
        F.when(p.isNull(), "baseline").when((s == "error") | (p == "error"), "indeterminate").when((p == "not_configured") & (s != "not_configured"), "newly_configured").when((p != "not_configured") & (s == "not_configured"), "no_longer_configured")
        .when((p == "not_cited") & cited, "newly_cited").when(p.isin("cited", "mixed") & (s == "not_cited"), "possible_loss").when((s == "not_cited") & (p == "not_cited") & pp.isin("cited", "mixed"), "confirmed_loss")
        .when((s == p) & cited & (F.size(F.array_except(F.transform("urls", url_key), F.transform("pu", url_key))) > 0), "cited_other_pages").when(s == p, "unchanged").otherwise("state_changed")
    )
    return rows.select("run_date", "prompt_id", "provider", "state", change.alias("change"))


def text_changes(prev: DataFrame, cur: DataFrame, most: int = 40) -> DataFrame:
    """Documents whose text changed: how many sentences were added and removed (as multisets), and the first ``most``
    different ones of each, in order of the text. Further ones are ranked away before lists are made."""
    p, c = prev.select("doc_id", F.col("text").alias("old")), cur.select("doc_id", F.col("text").alias("new"))
    both = p.join(c, "doc_id").filter(F.md5("old") != F.md5("new"))
    cut = lambda col, n: both.select("doc_id", F.posexplode(F.split(col, r"\. ")).alias("pos", "s"), F.lit(n).alias("n"))
    votes = cut("new", 1).unionByName(cut("old", -1)).groupBy("doc_id", "s").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("pos"))).alias("new"), F.min(F.when(F.col("n") < 0, F.col("pos"))).alias("old"))
    votes = votes.filter("n != 0").withColumn("more", F.col("n") > 0).withColumn("pos", F.when(F.col("more"), F.col("new")).otherwise(F.col("old")))
    counts = votes.groupBy("doc_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))
    first = votes.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "more").orderBy("pos"))).filter(F.col("rn") <= most)
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("rn", "s")))), lambda x: x["s"])
    lists = first.groupBy("doc_id").agg(listed(F.col("more")).alias("added_sentences"), listed(~F.col("more")).alias("removed_sentences"))
    return counts.join(lists, "doc_id")


def _rule_hits(pages: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``pages(path)`` with each rule ``(source)`` of the same ``by`` that fits: the exact path, or the part up
    to ``*`` or ``:`` as its beginning."""
    r = rules.select(*by, "source", F.regexp_extract("source", r"^([^*:]*)", 1).alias("_prefix"), F.col("source").rlike(r"[*:]").alias("_open")).distinct()
    exact = pages.join(r.filter("not _open").select(*by, F.col("source").alias("path"), "source"), [*by, "path"])
    wide = prefix_hits(pages, r.filter("_open and _prefix != ''").select(*by, "source", "_prefix"), by, prefix="_prefix")
    columns = [*pages.columns, "source"]
    return exact.select(columns).unionByName(wide.select(columns))


def expected_redirects(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Each declared rule against the first crawled page it matches: exact, or by prefix up to ``*`` or ``:``."""
    by = keys(rules, pages)
    met = _rule_hits(pages.select(*by, "path", "landing", "fetch_seq"), rules, by).groupBy(*by, "source").agg(F.min_by(F.struct("path", "landing"), "fetch_seq").alias("m"))
    rows = rules.join(met, [*by, "source"], "left")
    state = F.when(F.col("m").isNull(), "not_observed").when(F.col("m.landing").isNull(), "not_honoured").when(F.col("m.landing") != F.col("target"), "wrong_destination").otherwise("confirmed")
    return rows.select(*by, "source", "target", F.col("m.path").alias("path"), state.alias("state"))


def undeclared_redirects(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that redirect although no rule fits their path."""
    by = keys(rules, pages)
    moved = pages.filter("landing is not null")
    ruled = _rule_hits(moved.select(*by, "path").distinct(), rules, by).select(*by, "path").distinct()
    return moved.join(ruled, [*by, "path"], "left_anti").select(*by, "path", "landing", F.lit("low").alias("severity"))


def migration_coverage(old_urls: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each old path redirects now or has a rule; else why not. A loop counts as missing whatever rule there is."""
    by = keys(old_urls, pages, rules)
    old, seen = old_urls.select(*by, "path"), pages
    seen = seen if "error_type" in seen.columns else seen.withColumn("error_type", F.lit(""))
    ruled = _rule_hits(old.distinct(), rules, by).select(*by, "path").distinct().withColumn("ruled", F.lit(True))
    rows = old.join(seen.select(*by, "path", "status", "landing", "error_type"), [*by, "path"], "left").join(ruled, [*by, "path"], "left")
    state = (
        F.when(F.col("error_type") == "too_many_redirects", "redirect_loops").when(F.col("landing").isNotNull(), "covered_live").when(F.col("ruled"), "covered_by_rule")
        .when(F.col("status") == 200, "still_200").otherwise("unreachable")
    )
    return rows.select(*by, "path", state.alias("state"))


def migration_summary(coverage: DataFrame) -> DataFrame:
    """Old paths, how many are covered and missing, and whether the launch must wait, for each site."""
    covered = F.col("state").isin("covered_live", "covered_by_rule")
    counts = F.count("*").alias("old_urls"), F.count_if(covered).alias("covered"), F.count_if(~covered).alias("missing"), F.coalesce(F.bool_or(~covered), F.lit(False)).alias("launch_blocker")
    return coverage.groupBy(*keys(coverage)).agg(*counts)


def broken_backlinks(links: DataFrame) -> DataFrame:
    """Links to targets that answer 400 or more; unknown and server errors weigh more."""
    code = F.col("http_code")
    return links.filter(code.isNull() | (code >= 400)).withColumn("severity", F.when(code.isNull() | (code >= 500), "high").otherwise("medium"))


def redirect_classes(pages: DataFrame) -> DataFrame:
    """Class of each page's redirect walk: loop, normalising or real hops, chains."""
    chain = F.col("redirect_chain")
    urls = F.concat(F.transform(chain, lambda h: h["url"]), F.array("final_url"))
    nxt = F.transform(chain, lambda h: h["location"])
    n = F.size(chain)
    loop = (F.col("error_type") == "too_many_redirects") | (F.size(F.array_distinct(urls)) < F.size(urls))
    same = F.zip_with(F.transform(chain, lambda h: url_key(h["url"])), F.transform(nxt, url_key), lambda a, b: a == b)
    normal = F.forall(same, lambda x: x)
    kind = F.when(n == 0, F.when(loop, "redirect_loop")).when(loop, "redirect_loop").when((n == 1) & normal, "normalizing_redirect").when(n == 1, "single_redirect").when(normal, "normalizing_chain").otherwise("redirect_chain")
    sev = F.when(F.col("type") == "redirect_loop", "critical").when(F.col("type") == "redirect_chain", F.when(F.col("hops") >= 3, "high").otherwise("medium")).when(F.col("type") == "normalizing_chain", "low").otherwise("info")
    return pages.select("url", kind.alias("type"), n.alias("hops")).filter("type is not null").withColumn("severity", sev)
