"""Checks of served pages: rendering gaps, cloaking, crawler blocks, assertions, hreflang, evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import is_indexable, is_noindex
from ..functions.sites import keys, page_keys
from ..functions.urls import host_key, url_key

#: Traces of client-side frameworks in markup.
HYDRATION = ("__NEXT_DATA__", "__NUXT__", "data-reactroot", "ng-version", "data-sveltekit", "astro-island")
CHALLENGE = ("just a moment", "attention required", "captcha", "verify you are human")


def _empty_mount() -> Column:
    """Whether an element of id root or app holds fewer than ten words. Where an element of its kind stands in it,
    its end is not known, and all that follows counts."""
    open_ = r"""(?is)<(\w+)[^>]*\bid\s*=\s*["']?(?:root|app)["'\s>]"""
    bare = F.regexp_replace("html", r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    tag = F.lower(F.regexp_extract(bare, open_, 1))
    rest = F.regexp_extract(bare, open_ + r"[^>]*>?(.*)", 2)
    inner = F.regexp_extract(bare, open_ + r"[^>]*>?(.*?)</\1\s*>", 2)
    nested = F.contains(F.lower(inner), F.concat(F.lit("<"), tag))
    words = F.regexp_count(F.regexp_replace(F.when(nested | (inner == ""), F.when(inner == "", F.lit("")).otherwise(rest)).otherwise(inner), "<[^>]*>", " "), F.lit(r"\S+"))
    return (tag != "") & (words < 10)


def js_dependency(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with few words and a trace of client-side rendering, or a mount node with next to no text."""
    marker = _empty_mount()
    for m in HYDRATION:
        marker = marker | F.col("html").contains(m)
    return pages.filter((F.col("word_count") < least) & marker).select(*keys(pages), "url", "word_count", F.when(F.col("word_count") < 30, "high").otherwise("medium").alias("severity"))


def render_gap(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Words of a page as served and as rendered. With ``page_id`` on both sides a row meets that of its own page, also
    where pages share an address."""
    by = [*page_keys(raw, rendered), "url"]
    both = raw.select(*by, F.col("words").alias("raw_words")).join(rendered.select(*by, F.col("words").alias("rendered_words")), by)
    gap = F.round((F.col("rendered_words") - F.col("raw_words")) / F.greatest("rendered_words", F.lit(1)), 4)
    return both.withColumn("gap", gap).withColumn("js_dependent", (F.col("rendered_words") > 1.5 * F.col("raw_words")) & (F.col("rendered_words") > 100))


def crawler_block_signals(variants: DataFrame) -> DataFrame:
    """Whether a response is a challenge: a blocking status with challenge headers or body."""
    body = F.lower(F.coalesce("body", F.lit("")))
    sign = F.lower(F.coalesce("headers", F.lit(""))).rlike("cf-mitigated|x-datadome|x-sucuri")
    for c in CHALLENGE:
        sign = sign | body.contains(c)
    return variants.withColumn("blocked", F.col("status").isin(403, 429, 503)).withColumn("challenge", F.col("status").isin(403, 429, 503) & sign)


def served_content_divergence(variants: DataFrame) -> DataFrame:
    """Bots against two human fetches of a page ``(url, role, status, hash, words)``; roles human_before, human_after
    and bots. A bot diverges only above max(0.15, 3 x the humans' variance) against both. With ``page_id`` the fetches of
    each page are apart, also where pages share an address."""
    by = [*page_keys(variants), "url"]
    ok = F.col("status") == 200
    human = variants.filter(F.col("role").isin("human_before", "human_after")).groupBy(*by).agg(F.max(F.when(ok & (F.col("role") == "human_before"), F.struct("hash", "words"))).alias("h1"), F.max(F.when(ok & (F.col("role") == "human_after"), F.struct("hash", "words"))).alias("h2"))
    off = lambda a, b: F.abs(a - b) / F.greatest(a, b, F.lit(1))
    natural = F.when(F.col("h1.hash") == F.col("h2.hash"), 0.0).otherwise(off(F.col("h1.words"), F.col("h2.words")))
    rows = variants.filter(~F.col("role").isin("human_before", "human_after")).join(human, by, "left")
    limit = F.greatest(F.lit(0.15), 3 * natural)
    far = (off(F.col("words"), F.col("h1.words")) > limit) & (off(F.col("words"), F.col("h2.words")) > limit)
    state = F.when(F.col("h1").isNull() | F.col("h2").isNull(), "not_checked").when(~ok, "blocked").when(far, "diverges").otherwise("same")
    return rows.select(*by, "role", state.alias("state"))


def hreflang_not_reciprocal(pages: DataFrame) -> DataFrame:
    """Targets ``(src, dst)`` that are crawled but do not point back."""
    links = pages.select(url_key("url").alias("src"), F.explode("hreflang").alias("h")).select("src", url_key("h.href").alias("dst")).filter("src != dst").distinct()
    known = pages.select(url_key("url").alias("dst")).distinct()
    back = links.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return links.join(known, "dst", "left_semi").join(back, ["src", "dst"], "left_anti").select("src", "dst")


def noindex_evidence(noindex: DataFrame, sitemap: DataFrame, traffic: DataFrame, intentional: str = r"/(?:cart|checkout|login|account|search|admin)(?:/|$)") -> DataFrame:
    """Noindex pages with search impressions are high, only in the sitemap medium, else counted; intended ones left out."""
    rows = noindex.filter(~F.col("url").rlike(intentional)).withColumn("key", url_key("url"))
    rows = rows.join(traffic.select("key", "impressions"), "key", "left").join(sitemap.select("key", F.lit(True).alias("listed")).distinct(), "key", "left")
    sev = F.when(F.coalesce("impressions", F.lit(0)) > 0, "high").when(F.col("listed"), "medium").otherwise("none")
    return rows.select("url", sev.alias("severity"))


def canonical_disagreement(rows: DataFrame) -> DataFrame:
    state = F.when(F.coalesce("selected", F.lit("")) == "", "not_selected_yet").when(url_key("declared") == url_key("selected"), "agrees").otherwise("disagrees")
    return rows.select("url", state.alias("state"))


def assert_pages(pages: DataFrame, assertions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``(url, kind, expected[, name])`` against page records: pass or fail of each, on every record of its address.

    Kinds: title, text_present, text_absent, status, canonical, indexable (``expected`` true or false), header
    (``name`` in the map ``headers``) and robots_allowed (agent ``name`` by ``allowed(url, agent, allowed)``). What isn't known fails.
    A record with a column ``fetched`` that is false stands for a page of which nothing is known. With ``page_id`` in
    ``pages`` and ``allowed``, a record meets what its own page allows, also where pages share an address.
    """
    rows = assertions if "name" in assertions.columns else assertions.withColumn("name", F.lit(None).cast("string"))
    by = [*([] if allowed is None else page_keys(pages, allowed)), "url"]
    known = lambda c, kind="string": F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    text = known("text") if "text" in pages.columns else known("html")
    directives = F.lower(F.concat_ws(" ", known("x_robots_tag"), known("meta_robots")))
    facts = pages.select(*by, *[known(c).alias(f"_{c}") for c in ("title", "status", "canonical")], known("headers", "map<string,string>").alias("_headers"), _squeezed(text).alias("_text"), (~directives.rlike("noindex|none")).alias("_indexable"), (known("fetched", "boolean") if "fetched" in pages.columns else F.lit(True)).alias("_known"))
    rows = rows.join(facts, "url", "left")
    if allowed is not None:
        rows = rows.join(allowed.select(*by, F.col("agent").alias("name"), "allowed"), [*by, "name"], "left")
    else:
        rows = rows.withColumn("allowed", F.lit(None).cast("boolean"))
    wanted, kind = F.col("expected"), F.col("kind")
    ok = (
        F.when(kind == "title", F.trim("_title") == wanted).when(kind == "text_present", F.contains("_text", _squeezed(wanted))).when(kind == "text_absent", ~F.contains("_text", _squeezed(wanted)))
        .when(kind == "status", F.col("_status").cast("string") == wanted).when(kind == "canonical", F.col("_canonical") == wanted).when(kind == "indexable", F.col("_indexable").cast("string") == F.lower(wanted))
        .when(kind == "header", F.col("_headers")[F.col("name")] == wanted).when(kind == "robots_allowed", F.col("allowed").cast("string") == F.lower(wanted))
    )
    return rows.select("url", "kind", "name", "expected", (F.coalesce(ok, F.lit(False)) & F.coalesce("_known", F.lit(False))).alias("pass"))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_verdicts(results: DataFrame) -> DataFrame:
    """Whether all assertions of a page hold, and how many don't."""
    return results.groupBy("url").agg(F.count("*").alias("assertions"), F.count_if(~F.col("pass")).alias("failed"), F.bool_and("pass").alias("pass"))


def network_footprint(links: DataFrame, hosts: list[str]) -> DataFrame:
    """Sites ``(site, link)`` that link to one of the hosts or their subdomains."""
    host = host_key("link")
    hit: Column = F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | host.endswith("." + h)
    return links.filter(hit).groupBy("site").agg(F.count("*").alias("links"))


def citation_sources(links: DataFrame, trail: DataFrame, own_host: str) -> DataFrame:
    """``(doc_id, url, pos)``: distinct external links in order, then quoted sources that are not linked."""
    first = links.filter(host_key("url") != own_host).groupBy("doc_id", "url").agg(F.min("pos").alias("pos"))
    rest = trail.join(first, ["doc_id", "url"], "left_anti").groupBy("doc_id", "url").agg((F.min("pos") + 1_000_000).alias("pos"))
    return first.unionByName(rest)


#: Rules of a generated site: kinds of pages (None: all; "-" before the names: all but these), code, severity, what is wrong,
#: as SQL over page records and their ``kind``. Where a rule has no value to look at, it says nothing.
SITE_RULES = (
    (None, "html-lang", "error", "coalesce(trim(lang), '') = ''"),
    ("search notfound", "robots-meta", "warn", "NOT contains(meta_robots, 'noindex')"),
    ("-search notfound", "robots-meta", "error", "contains(meta_robots, 'noindex')"),
    ("-search notfound", "robots-meta", "warn", "NOT contains(meta_robots, 'index')"),
    ("-search notfound", "canonical", "error", "canonical = ''"),
    ("-search notfound", "canonical", "error", "canonical != '' AND NOT rlike(canonical, '^[A-Za-z][A-Za-z0-9+.-]*:')"),
    ("-search notfound", "canonical", "error", "rlike(canonical, '^[A-Za-z][A-Za-z0-9+.-]*:') AND rtrim('/', canonical) != rtrim('/', url)"),
    *(("-search notfound", "open-graph", "warn", f"coalesce(og['{p}'], '') = ''") for p in ("og:title", "og:description", "og:url", "og:type")),
    ("-search notfound", "twitter-card", "warn", "coalesce(twitter['twitter:card'], '') = ''"),
    ("-notfound", "jsonld-graph", "error", "NOT (array_contains(json_ld_types, 'Organization') AND array_contains(json_ld_types, 'WebSite'))"),
    ("home", "jsonld-blog", "warn", "NOT array_contains(json_ld_types, 'Blog')"), ("author", "jsonld-profile", "warn", "NOT array_contains(json_ld_types, 'ProfilePage')"),
    ("about", "jsonld-about", "warn", "NOT array_contains(json_ld_types, 'AboutPage')"), ("section", "jsonld-collection", "info", "NOT array_contains(json_ld_types, 'CollectionPage')"),
    ("post", "open-graph", "warn", "og['og:type'] != 'article'"), ("post", "jsonld-article", "error", "NOT arrays_overlap(json_ld_types, array('BlogPosting', 'Article', 'NewsArticle'))"),
    ("post", "jsonld-breadcrumb", "warn", "NOT array_contains(json_ld_types, 'BreadcrumbList')"), ("post", "h1", "error", "size(h1) != 1"), ("post", "structure", "warn", "size(h2) < 4"),
    ("post", "citation-mirror", "warn", "citations != source_links"), ("post", "internal-links", "warn", "size(filter(internal_links, x -> contains(x, '/posts/'))) = 0"),
    ("post", "img-alt", "error", "images_missing_alt > 0"), ("post", "img-dimensions", "warn", "images_without_size > 0"), ("post", "cover", "warn", "coalesce(og['og:image'], '') = ''"), ("post", "length", "warn", "word_count < 300"),
)


def site_conformance(pages: DataFrame, rules: tuple = SITE_RULES) -> DataFrame:
    """``(url, kind, code, severity, rule)`` for each rule that a page of its kind breaks; rules that name a column which
    ``pages(url, kind, ..)`` lacks are left out. One pass over the pages, whatever the number of rules."""
    have = set(pages.columns) | {"x"}
    made = []
    for kinds, code, severity, wrong in rules:
        named = set(re.findall(r"\b[a-z_]\w*\b(?!\()", re.sub(r"'[^']*'", "", wrong))) - {"true", "false"}
        if named <= have:
            own = F.lit(True) if kinds is None else ~F.col("kind").isin(kinds[1:].split()) if kinds.startswith("-") else F.col("kind").isin(kinds.split())
            made.append(F.when(own & F.coalesce(F.expr(wrong), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(wrong).alias("rule"))))
    by = keys(pages)
    return pages.select(*by, "url", "kind", F.explode(F.filter(F.array(*made), lambda f: f.isNotNull())).alias("f")).select(*by, "url", "kind", "f.*")


def conformance_counts(found: DataFrame) -> DataFrame:
    """Pages and findings of each code and severity."""
    return found.groupBy(*keys(found), "code", "severity").agg(F.count("*").alias("findings"), F.count_distinct("url").alias("pages"))


def sitemap_mismatch(crawl: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Indexable self-canonical pages (with their ``key``) that the sitemap lacks, and sitemap pages that it should not list."""
    by = keys(crawl, sitemap)
    elsewhere = (F.col("canonical") != "") & (url_key("canonical") != F.col("key"))
    lacking = crawl.filter(is_indexable() & ~elsewhere).join(sitemap, [*by, "key"], "left_anti").select(*by, "url", F.lit("missing_from_sitemap").alias("reasons"))
    why = F.concat_ws(", ", F.when(F.col("status") != 200, "not_200"), F.when(is_noindex(), "noindex"), F.when(elsewhere, "canonical_elsewhere"))
    listed = crawl.filter("error_type = ''").join(sitemap, [*by, "key"], "left_semi").select(*by, "url", why.alias("reasons")).filter("reasons != ''")
    return lacking.unionByName(listed)
