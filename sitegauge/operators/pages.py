"""Page audits: one record per identity, metadata issues, duplicates, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pages import fetched, findings, is_html, is_indexable, is_nofollow, is_noindex, severity_rank
from ..functions.sites import keys
from ..functions.text import jaccard, terms
from ..functions.urls import host_key, same_site, url_key
from ..sources.tables import checkpointed


def resolve_url_identity(df: DataFrame, col: str = "url", key: str = "key") -> DataFrame:
    return df.withColumn(key, url_key(col))


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``; a key may hold any share of the rows (partial aggregates)."""
    columns = [c for c in df.columns if c not in by]
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*by, F.struct(*[o.alias(n) for o, n in zip(order, names)]).alias("_o"), F.struct(*columns).alias("_r"))
    return rows.groupBy(*by).agg(F.min_by("_r", "_o").alias("_r")).select(*by, "_r.*").select(df.columns)


def last_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    columns = [c for c in df.columns if c not in by]
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*by, F.struct(*[o.alias(n) for o, n in zip(order, names)]).alias("_o"), F.struct(*columns).alias("_r"))
    return rows.groupBy(*by).agg(F.max_by("_r", "_o").alias("_r")).select(*by, "_r.*").select(df.columns)


def dedupe_by_identity(pages: DataFrame, keep: str = "first", url: str = "url", group: tuple[str, ...] = ("crawl_id",)) -> DataFrame:
    """One record per identity and crawl: the first or last by ``fetch_seq``."""
    keyed = pages.withColumn("key", url_key(url))
    return (first_by if keep == "first" else last_by)(keyed, [*keys(pages), *group, "key"], F.col("fetch_seq"))


def pages_on_site(pages: DataFrame, host: str, include_subdomains: bool = False) -> DataFrame:
    return pages.filter(same_site("url", F.lit(host), include_subdomains))


def cross_host_canonical(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("canonical") != "") & (host_key("canonical") != host_key("url"))).select(*keys(pages), "crawl_id", "url", F.lit("cross_domain_canonical").alias("type"), F.lit("critical").alias("severity"), F.col("canonical").alias("detail"))


def noindex_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(is_noindex())


def nofollow_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(is_nofollow())


def indexable_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(is_indexable())


def metadata_issues(pages: DataFrame) -> DataFrame:
    """Missing or ill-sized titles and descriptions, missing cards and headings, title unlike the heading."""
    title, desc = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("meta_description", F.lit("")))
    n, m = F.char_length(title), F.char_length(desc)
    h1 = F.coalesce(F.get("h1", 0), F.lit(""))
    a, b = (F.array_distinct(terms(c, "metadata")) for c in (title, h1))
    alike = jaccard(a, b)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    gone = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return findings(
        pages,
        (n == 0, "missing_title", "high", F.lit("")), (m == 0, "missing_meta_description", "medium", F.lit("")),
        (n > 60, "title_too_long", "medium", n), ((n > 0) & (n < 30), "title_too_short", "low", n),
        (m > 155, "description_too_long", "low", m), ((m > 0) & (m < 70), "description_too_short", "low", m),
        (gone("og_title"), "missing_og_title", "low", F.lit("")), (gone("og_description"), "missing_og_description", "low", F.lit("")),
        (gone("og_image"), "missing_og_image", "low", F.lit("")), (gone("twitter_card"), "missing_twitter_card", "low", F.lit("")),
        (F.coalesce(F.size("h1"), F.lit(0)) == 0, "missing_h1", "medium", F.lit("")), (both & (alike < 0.15), "title_h1_mismatch", "low", F.lit("")),
        keep=(*keys(pages), "url"),
    )


def page_opportunities(pages: DataFrame, sample: int = 10) -> DataFrame:
    """Ten page-level rules counted over the site: ``(type, impact, effort, count, sample_urls)``, by impact, then count.

    Samples are the least urls of pages that answered 200. The rule on images counts those of all pages, if any such
    page has one. Rules on columns that ``pages`` lacks are left out.
    """
    ok = fetched() & F.coalesce(F.col("status") == 200, F.lit(False))
    page = ok & is_html()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    size, one = lambda c: F.coalesce(F.size(c), F.lit(0)), F.lit(1)
    rules = {
        "title": [("missing_title_tag", "high", "low", lambda: page & blank("title"), one)],
        "meta_description": [("missing_meta_description", "medium", "low", lambda: page & blank("meta_description"), one)],
        "h1": [("missing_h1", "medium", "low", lambda: page & (size("h1") == 0), one), ("multiple_h1", "low", "low", lambda: ok & (size("h1") > 1), one)],
        "json_ld_types": [("no_structured_data", "medium", "medium", lambda: page & (size("json_ld_types") == 0), one)],
        "json_ld_errors": [("invalid_json_ld", "medium", "low", lambda: ok & (size("json_ld_errors") > 0), one)],
        "depth": [("excessive_link_depth", "low", "medium", lambda: ok & (F.col("depth") > 4), one)],
        "images_missing_alt": [("images_missing_alt_text", "low", "medium", lambda: F.col("images_missing_alt") > 0, F.col("images_missing_alt"))],
        "word_count": [("thin_content", "medium", "high", lambda: page & (F.col("word_count") > 0) & (F.col("word_count") < 150), one)],
        "lang": [("missing_html_lang", "low", "low", lambda: page & blank("lang"), one)],
    }
    made = [F.when(cond(), F.struct(F.lit(kind).alias("type"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), n.cast("bigint").alias("n"), ok.alias("ok"))) for c, own in rules.items() if c in pages.columns for kind, impact, effort, cond, n in own]
    rows = pages.select(*keys(pages), "url", F.explode(F.filter(F.array(*made), lambda f: f.isNotNull())).alias("f")).select(*keys(pages), "url", "f.*")
    by = [*keys(pages), "type"]
    counts = rows.groupBy(*by, "impact", "effort").agg(F.sum("n").alias("count"), F.count_if("ok").alias("_ok")).filter("_ok > 0").drop("_ok")
    ranked = rows.filter("ok").withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("url")))
    top = ranked.filter(F.col("rn") <= sample).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("url")), "\n").alias("sample_urls"))
    rank = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    return counts.join(top, by).orderBy(*keys(pages), rank, F.desc("count"), "type")


def register_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """User rules ``(type, severity, SQL predicate)`` applied in one pass over the pages."""
    return findings(pages, *[(F.coalesce(F.expr(p), F.lit(False)), t, s, F.lit(p)) for t, s, p in rules])


def duplicate_values(pages: DataFrame, col: str = "title") -> DataFrame:
    """Values that more than one identity shows: a row ``(type, severity, value, pages, url)`` for each, so that no value
    gathers its urls. A shared title weighs more than other shared values."""
    by = [*keys(pages), "value"]
    rows = pages.select(*keys(pages), F.trim(F.coalesce(F.col(col), F.lit(""))).alias("value"), "url").filter("value != ''")
    shared = rows.join(rows.groupBy(*by).agg(F.count("*").alias("pages")).filter("pages > 1"), by)
    return shared.select(*keys(pages), F.lit(f"duplicate_{col}").alias("type"), F.lit("high" if col == "title" else "medium").alias("severity"), "value", "pages", "url")


def finding_rollup(rows: DataFrame) -> DataFrame:
    """Counts by severity, by type and overall in one pass."""
    return rows.groupingSets([["severity"], ["type"], []], "severity", "type").agg(F.count("*").alias("n"))


def order_by_severity(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(severity_rank() == 0, 9).otherwise(severity_rank()), "url", "type")


def crawl_summary(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(F.col("error_type") != "").alias("errors"), F.count_if(F.col("status") != 200).alias("not_ok"))


def page_map(pages: DataFrame, max_pages: int = 500) -> DataFrame:
    """Of the first ``max_pages`` indexable titled pages in order of fetching: ``(segment, url, title, description)``,
    by first path segment and url."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*/+([^?#]*)", 1)
    first = F.regexp_extract(path, "^([^/]*)", 1)
    rows = pages.filter(is_indexable() & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    rows = rows.select(*keys(pages), "fetch_seq", F.when(first == "", "top-level").otherwise(first).alias("segment"), "url", F.trim("title").alias("title"), F.trim(F.coalesce("meta_description", F.lit(""))).alias("description"))
    if keys(pages):
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("site").orderBy("fetch_seq", "url"))).filter(F.col("_rn") <= max_pages).drop("_rn")
    else:
        rows = rows.orderBy("fetch_seq", "url").limit(max_pages)
    return rows.drop("fetch_seq").orderBy(*keys(pages), "segment", "url")


#: Patterns of paths and of titles and headings that tell the schema type of a page, in order.
PATH_HINTS = (
    (r"(?i)/blog/|/posts?/|/news/|/articles?/", "BlogPosting"), (r"(?i)/product/|/products/|/shop/|/p/\d", "Product"), (r"(?i)/faq/?$|/faqs/?$|frequently-asked-questions", "FAQPage"), (r"(?i)/recipes?/", "Recipe"),
    (r"(?i)/how-to-|/guide/|/tutorial/", "HowTo"), (r"(?i)/locations?/|/stores?/|/branches?/", "LocalBusiness"), (r"(?i)/team/|/authors?/|/people/|/staff/", "Person"),
)
HEADING_HINTS = ((r"(?i)\bhow to\b", "HowTo"), (r"(?i)\brecipe\b", "Recipe"), (r"(?i)\bfaqs?\b|frequently asked questions", "FAQPage"))


def infer_schema_type(pages: DataFrame, paths: tuple = PATH_HINTS, headings: tuple = HEADING_HINTS) -> DataFrame:
    """For pages without JSON-LD the first rule ``(pattern, type)`` that fits the path, else title and first-level
    headings, else Organization for the home page: ``(url, schema_type)``."""
    if "json_ld_types" in pages.columns:
        pages = pages.filter(F.coalesce(F.size("json_ld_types"), F.lit(0)) == 0)
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    text = F.concat_ws(" ", *[F.coalesce(F.col(c) if c == "title" else F.array_join(c, " "), F.lit("")) for c in ("title", "h1") if c in pages.columns])
    kind = F.coalesce(*[F.when(path.rlike(p), t) for p, t in paths], *[F.when(text.rlike(p), t) for p, t in headings], F.when(path.isin("", "/"), "Organization"))
    return pages.select(*keys(pages), "url", kind.alias("schema_type")).filter("schema_type is not null")


def with_page_kind(pages: DataFrame) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    first = F.regexp_extract(path, "^/([^/]*)", 1)
    known = {"posts": "post", "sections": "section", "authors": "author", "about": "about", "search": "search", "404.html": "notfound"}
    kind = F.when(first == "", "home")
    for segment, name in known.items():
        kind = kind.when(first == segment, name)
    return pages.withColumn("kind", kind.otherwise("other")).withColumn("slug", F.regexp_extract(path, "^/posts/([^/]+)", 1))


def key_pages(pages: DataFrame, clicks: DataFrame, n: int = 10) -> DataFrame:
    """Home page, then indexable pages by order of fetching, then the most clicked, distinct, first n."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    own = pages.filter(is_indexable()).select(url_key("url").alias("key"), F.when(path.isin("", "/"), 0).otherwise(1).alias("pri"), F.col("fetch_seq").cast("double").alias("pos"))
    rows = own.unionByName(clicks.select(url_key("url").alias("key"), F.lit(2).alias("pri"), (-F.col("clicks")).cast("double").alias("pos")))
    best = rows.groupBy("key").agg(F.min(F.struct("pri", "pos")).alias("b"))
    return best.orderBy("b.pri", "b.pos", "key").limit(n).select("key", F.col("b.pri").alias("pri"))


def stride_sample(df: DataFrame, n: int, by: str = "url") -> DataFrame:
    """Every max(count / n, 1)-th row by order, n at most. Ranks come from ranges, not from one task."""
    total = df.count()
    stride = max(total // n, 1)
    return with_global_rank(df, by).filter((F.pmod(F.col("rank") - 1, F.lit(stride)) == 0) & (F.col("rank") <= stride * n)).drop("rank")


def with_global_rank(df: DataFrame, *by: str | Column, name: str = "rank") -> DataFrame:
    """Row numbers over the whole table by way of range partitions and their sizes (one row per task).

    The partitions are written first: their bounds are drawn by sampling, so a second run might cut elsewhere.
    """
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = checkpointed(parts, "ranked")
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    start, total = [], 0
    for r in sorted(parts.groupBy("_p").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_p"]):
        start.append((r["_p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(start, "_p int, _start bigint")
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + low + 1).select(*df.columns, name)


def with_group_rank(df: DataFrame, group: list[str], *by: str | Column, name: str = "rank") -> DataFrame:
    """Row numbers within each group, which may hold any share of the rows: ranks over all less the group's first."""
    ranked = checkpointed(with_global_rank(df, *group, *by, name="_all"), "group-ranked")
    first = ranked.groupBy(*group).agg(F.min("_all").alias("_first"))
    return ranked.join(first, group).withColumn(name, F.col("_all") - F.col("_first") + 1).select(*df.columns, name)
