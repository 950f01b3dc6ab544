"""Derived views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_search": """SELECT concat('q', user_id % 40) AS key, concat('/p/', user_id % 25) AS page, CAST(ts AS DATE) AS d,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
  CAST(SUM(CASE WHEN event_type IN ('click','view') THEN 1 + event_id % 7 ELSE 0 END) AS BIGINT) AS impressions,
  AVG(CAST(1 + event_id % 30 AS DOUBLE)) AS position
FROM events GROUP BY user_id % 40, user_id % 25, CAST(ts AS DATE)""",
    "v_crawl": """SELECT c.crawl_id, p.page_id AS fetch_seq, p.url, p.html, 'text/html' AS content_type, '' AS x_robots_tag,
  CASE WHEN c.crawl_id = 'B' AND p.page_id % 17 = 4 THEN 404 WHEN c.crawl_id = 'B' AND p.page_id % 23 = 6 THEN 503 ELSE 200 END AS status,
  CASE WHEN c.crawl_id = 'B' AND p.page_id % 29 = 8 THEN 'timeout' ELSE '' END AS error_type,
  CASE WHEN c.crawl_id = 'B' AND p.page_id % 13 = 2 THEN 'noindex' WHEN p.page_id % 31 = 1 THEN 'none' ELSE '' END AS meta_robots,
  CASE WHEN c.crawl_id = 'B' AND p.page_id % 19 = 3 THEN concat('https://other.example/', p.page_id) WHEN p.page_id % 5 = 0 THEN p.url ELSE '' END AS canonical,
  CASE WHEN c.crawl_id = 'B' AND p.page_id % 7 = 6 THEN concat('https://moved.example/', p.page_id) ELSE p.url END AS final_url,
  concat(p.page_id, CASE WHEN c.crawl_id = 'B' AND p.page_id % 4 = 1 THEN '-changed' ELSE '' END) AS content_version
FROM pages p CROSS JOIN (SELECT 'A' AS crawl_id UNION ALL SELECT 'B') c
WHERE NOT (c.crawl_id = 'A' AND p.page_id % 11 = 3) AND NOT (c.crawl_id = 'B' AND p.page_id % 11 = 5)""",
    "v_facts": """SELECT page_id, url, CASE WHEN page_id % 9 = 4 THEN ' ' WHEN page_id % 9 = 5 THEN concat('How to ', page_id) ELSE concat('Title ', page_id % 50) END AS title,
  CASE WHEN page_id % 8 = 3 THEN '' ELSE concat('About ', page_id % 40) END AS meta_description, page_id % 3 AS n_h1, page_id % 6 AS n_h2, CASE WHEN page_id % 7 = 2 THEN '' ELSE 'en' END AS lang, CAST(page_id % 8 AS INT) AS depth,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Organization,WebSite' WHEN 2 THEN 'Organization,WebSite,BlogPosting,BreadcrumbList' WHEN 3 THEN 'Organization,WebSite,Blog,AboutPage' ELSE 'Article' END AS types,
  CASE WHEN page_id % 11 = 5 THEN 1 ELSE 0 END AS ld_errors, CASE WHEN page_id % 6 = 1 THEN page_id % 4 ELSE 0 END AS images_missing_alt, CAST(page_id * 37 % 400 AS INT) AS word_count,
  CASE WHEN page_id % 13 = 12 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 17 = 16 THEN 'timeout' ELSE '' END AS error_type, CASE WHEN page_id % 10 = 9 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
  CASE page_id % 4 WHEN 0 THEN 'noindex' WHEN 1 THEN '' ELSE 'index, follow' END AS meta_robots, '' AS x_robots_tag,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/relative' WHEN 2 THEN concat(url, '/') WHEN 3 THEN 'https://else.example/' ELSE url END AS canonical,
  CASE page_id % 8 WHEN 0 THEN 'home' WHEN 1 THEN 'author' WHEN 2 THEN 'about' WHEN 3 THEN 'section' WHEN 4 THEN 'search' WHEN 5 THEN 'notfound' ELSE 'post' END AS kind,
  page_id % 4 AS citations, page_id % 3 AS source_links, CASE WHEN page_id % 2 = 0 THEN 'article' ELSE 'website' END AS og_type
FROM pages""",
    "v_edges": """SELECT src, dst FROM (
  SELECT page_id AS src, page_id * 2 + 1 AS dst FROM pages UNION
  SELECT page_id, page_id * 2 + 2 FROM pages UNION
  SELECT page_id, page_id - page_id % 10 FROM pages) e
WHERE dst IN (SELECT page_id FROM pages) AND dst % 7 <> 5 AND src <> dst""",
    "v_alias": "SELECT page_id AS src, page_id + 1 AS dst FROM pages WHERE page_id % 6 IN (2, 3)",
    "v_backlinks": """SELECT r.run, concat('https://d', l_suppkey % 40, '.example/', l_orderkey, '-', l_linenumber) AS url_from, concat('https://site.example/', l_partkey % 50) AS url_to,
  concat('d', l_suppkey % 40, '.example') AS source_domain, CAST(l_shipdate AS DATE) AS first_seen, (r.run = 2 AND l_orderkey % 37 = 0) AS is_lost
FROM lineitem CROSS JOIN (SELECT 1 AS run UNION ALL SELECT 2) r
WHERE NOT (r.run = 1 AND l_partkey % 9 = 1) AND NOT (r.run = 2 AND l_partkey % 9 = 2)""",
    "v_samples": """SELECT CAST(ts AS DATE) AS run_date, user_id % 12 AS prompt_id, event_type AS provider, event_id AS sample_id,
  CASE WHEN user_id % 12 = 7 AND event_type = 'click' OR event_id % 7 = 2 THEN 'not_configured' WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'cited' ELSE 'not_cited' END AS outcome,
  CASE event_id % 4 WHEN 0 THEN concat(' https://www.shop.example/p/', user_id % 5, '/ ') WHEN 1 THEN concat('http://shop.example/p/', user_id % 5, '?utm_source=x') WHEN 2 THEN 'https://other.example/' ELSE concat('https://redirect.example/', event_id) END AS url1,
  CASE WHEN event_id % 4 = 3 THEN 'Blog.shop.example' ELSE 'Some title' END AS title1, concat('https://news.other.example/', event_id % 3) AS url2
FROM events""",
    "v_traffic": """SELECT CAST(o_orderdate AS DATE) AS d, concat('/p/', o_custkey % 30) AS page,
  CASE o_custkey % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'www.chatgpt.com' ELSE 'news.example' END AS source,
  CASE WHEN o_custkey % 8 = 0 THEN 'cpc' WHEN o_custkey % 4 = 0 THEN 'organic' ELSE 'referral' END AS medium,
  COUNT(*) AS sessions, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS key_events
FROM orders GROUP BY CAST(o_orderdate AS DATE), o_custkey""",
    "v_posts": "SELECT concat('p', p_partkey) AS slug, p_name AS title, p_brand AS section, CAST(p_size AS BIGINT) AS age_days FROM part",
    "v_answers": "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'",
    "v_log": """SELECT event_id, ts, user_id % 256 AS octet,
  CASE event_type WHEN 'view' THEN 'GPTBot/1.0' WHEN 'click' THEN 'Mozilla/5.0 bingbot/2.0' WHEN 'signup' THEN 'SomeSpider/1' ELSE 'Mozilla/5.0' END AS agent
FROM events""",
    "v_meta": """SELECT concat('s', o_custkey % 50) AS site, concat('c', o_orderkey) AS crawl_id, CAST(o_orderdate AS DATE) AS finished_at,
  CASE WHEN o_orderkey % 5 = 0 THEN 200 ELSE 500 END AS max_pages, (o_orderkey % 7 = 0) AS truncated, CAST(o_orderkey % 600 AS BIGINT) AS pages_crawled
FROM orders""",
}
BASE = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "lineitem", "orders", "part", "customer", "supplier", "nation", "region")


class Tables:
    """Tables and derived views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, query: str) -> DataFrame:
        """A query over the driver's tables and the views above, with nothing registered in the session."""
        names = r"\b(FROM|JOIN|from|join) (" + "|".join(BASE) + r")\b"
        used = {name: getattr(self, name) for _, name in re.findall(names, query)}
        if not used:
            return self.spark.sql(query)
        literal = query.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(names, r"\1 {\2}", literal), **used)


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL with the views in-lined."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {body.lstrip()[5:]}" if head else body
    return f"WITH {head} {body}" if head else body


# ---------------------------------------------------------------- URL identity in DuckDB


def host_sql(u: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)), ':(80|443)$', ''), '\.+$', ''), '^www\.', '')"


def key_sql(u: str) -> str:
    path = f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|msclkid|mc_eid|igshid)'))), '&')"
    return f"(CASE WHEN {u} = '' THEN '' ELSE 'https://' || {host_sql(u)} || (CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END) || (CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END) END)"
