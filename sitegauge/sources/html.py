"""Page records from raw HTML: the one place where Python runs per batch, also as a table function."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RECORD = """page_id bigint, url string, title string, meta_description string, meta_robots string, canonical string, h1 array<string>, h2 array<string>, lang string,
hreflang array<struct<hreflang:string,href:string>>, internal_links array<string>, external_links array<string>, nofollow_links array<string>, images int, images_missing_alt int,
json_ld_types array<string>, json_ld_errors array<string>, og map<string,string>, twitter map<string,string>, word_count int, content_hash string"""
_UNSEEN = {"script", "style", "noscript", "template"}
_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Collects one page's facts while its tags go by."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.host = url, _host(url)
        self.r: dict = {"title": "", "meta_description": "", "meta_robots": "", "canonical": "", "lang": "", "h1": [], "h2": [], "hreflang": [], "internal_links": [], "external_links": [], "nofollow_links": [], "images": 0, "images_missing_alt": 0, "json_ld_types": [], "json_ld_errors": [], "og": {}, "twitter": {}}
        self.text: list[str] = []
        self.inside: list[str] = []
        self.held: list[str] | None = None
        self.want = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        bare = {k for k, _ in attrs}
        if tag == "html":
            self.r["lang"] = a.get("lang", "")
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            field = {"description": "meta_description", "robots": "meta_robots"}.get(name)
            if field and not self.r[field]:
                self.r[field] = content.strip()
            for kind, prefix in (("og", "og:"), ("twitter", "twitter:")):
                if name.startswith(prefix):
                    self.r[kind].setdefault(name, content)
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and not self.r["canonical"]:
                self.r["canonical"] = urljoin(self.url, a.get("href", ""))
            if "alternate" in rel and a.get("hreflang"):
                self.r["hreflang"].append({"hreflang": a["hreflang"], "href": urljoin(self.url, a.get("href", ""))})
        elif tag == "a" and a.get("href") and not a["href"].lower().startswith(("mailto:", "tel:", "javascript:", "#")):
            link = urldefrag(urljoin(self.url, a["href"]))[0]
            kind = "internal_links" if _host(link) == self.host else "external_links"
            self.r[kind].append(link)
            if "nofollow" in a.get("rel", "").lower():
                self.r["nofollow_links"].append(link)
        elif tag == "img":
            self.r["images"] += 1
            self.r["images_missing_alt"] += "alt" not in bare
        if tag in _UNSEEN:
            self.inside.append(tag)
        if tag in ("title", "h1", "h2") or tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.want, self.held = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag == self.want and self.held is not None:
            value = "".join(self.held)
            if tag == "script":
                self._json_ld(value)
            elif tag == "title":
                self.r["title"] = self.r["title"] or _SPACE.sub(" ", value).strip()
            else:
                self.r[tag].append(_SPACE.sub(" ", value).strip())
            self.want, self.held = "", None
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data: str) -> None:
        if self.held is not None:
            self.held.append(data)
        if not self.inside:
            self.text.append(data)

    def _json_ld(self, value: str) -> None:
        try:
            todo = [json.loads(value)]
        except ValueError as e:
            self.r["json_ld_errors"].append(str(e))
            return
        while todo:
            node = todo.pop(0)
            if isinstance(node, list):
                todo += node
            elif isinstance(node, dict):
                kinds = node.get("@type", [])
                self.r["json_ld_types"] += [str(k) for k in (kinds if isinstance(kinds, list) else [kinds])]
                todo += node["@graph"] if isinstance(node.get("@graph"), list) else []


def _host(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def record(page_id: int | None, url: str | None, html: str | None) -> dict:
    reader = _Reader(url or "")
    reader.feed(html or "")
    reader.close()
    text = _SPACE.sub(" ", " ".join(reader.text)).strip()
    return {"page_id": page_id, "url": url} | reader.r | {"word_count": len(text.split()), "content_hash": hashlib.sha256(text.encode()).hexdigest()[:16]}


def markup_facts(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, url, html)`` with title, first heading, language and number of links as raw text of the markup, and the
    other columns of a page record empty: a quick native look where ``pages_to_records`` would parse all of the page."""
    rx = lambda p, g=1: F.regexp_extract("html", p, g)
    return pages.select(
        "page_id", F.col("page_id").alias("fetch_seq"), "url", rx("(?is)<title[^>]*>(.*?)</title>").alias("title"), rx("(?is)<h1[^>]*>(.*?)</h1>").alias("h1_text"), rx('(?is)<html[^>]*lang="([^"]*)"').alias("lang"),
        F.regexp_count("html", F.lit('<a href="')).cast("bigint").alias("n_links"), F.lit("A").alias("crawl_id"), F.lit(200).alias("status"), F.lit("").alias("error_type"), F.lit("text/html").alias("content_type"), F.lit("").alias("meta_robots"), F.lit("").alias("x_robots_tag"),
        F.lit("").alias("meta_description"), F.lit("").alias("og_title"), F.lit("").alias("og_description"), F.lit("").alias("og_image"), F.lit("").alias("twitter_card"), F.size(F.split("html", r"\s+")).alias("word_count"),
    ).withColumn("h1", F.filter(F.array("h1_text"), lambda h: h != ""))


def pages_to_records(pages: DataFrame) -> DataFrame:
    """A record of each row of ``pages(page_id, url, html)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([record(*r) for r in pdf[["page_id", "url", "html"]].itertuples(index=False)])

    return pages.select("page_id", "url", "html").mapInPandas(read, RECORD)


@udtf(returnType=RECORD)
class extract_html:  # noqa: N801  the name is the SQL name
    """``SELECT * FROM extract_html(TABLE(SELECT page_id, url, html FROM ..))``."""

    def eval(self, row):
        r = record(row["page_id"], row["url"], row["html"])
        yield tuple([(h["hreflang"], h["href"]) for h in v] if k == "hreflang" else v for k, v in r.items())
