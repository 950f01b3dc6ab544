"""Crawl snapshots: one JSON object per page, and one provenance row per snapshot, written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schemas import PAGE

META = "site string, crawl_id string, producer string, max_pages int, pages_crawled bigint, truncated boolean, finished_at timestamp"


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Page records with ``crawl_id`` (the folder ``crawl_id=..``, else the file) and ``fetch_seq`` (rank by time of fetching, then url)."""
    folder, file = (F.regexp_extract(F.col("_metadata.file_path"), p, 1) for p in (r"/crawl_id=([^/]+)/", r"([^/]+?)(?:\.[a-z]+)*$"))
    rows = spark.read.schema(PAGE).option("mode", "DROPMALFORMED").json(path).withColumn("crawl_id", F.when(folder != "", folder).otherwise(file))
    return with_fetch_seq(rows)


def with_fetch_seq(rows: DataFrame) -> DataFrame:
    from ..operators.pages import with_group_rank

    return with_group_rank(rows, ["crawl_id"], F.asc_nulls_last("fetched_at"), "url", name="fetch_seq")


def write_crawl(pages: DataFrame, meta: DataFrame, path: str) -> None:
    """Append a snapshot; the provenance row comes last, so that a fragment stays invisible."""
    pages.write.mode("append").partitionBy("site", "crawl_id").parquet(f"{path}/pages")
    meta.write.mode("append").parquet(f"{path}/meta")


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    meta = spark.read.schema(META).parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/pages").join(meta.select("site", "crawl_id"), ["site", "crawl_id"], "left_semi")


def read_access_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip logs; nothing is ever rejected."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_search_analytics(spark: SparkSession, path: str, dimensions: list[str], hit_cap: bool = False) -> DataFrame:
    """Landed rows with a column per dimension; rows of too few keys are dropped, ``hit_cap`` is carried along."""
    rows = spark.read.schema("keys array<string>, clicks bigint, impressions bigint, ctr double, position double").json(path)
    rows = rows.filter(F.size("keys") >= len(dimensions))
    return rows.select(*[F.element_at("keys", i + 1).alias(d) for i, d in enumerate(dimensions)], "clicks", "impressions", "ctr", "position", F.lit(hit_cap).alias("hit_cap"))


def read_traffic_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Traffic rows, and one row of metadata per export."""
    row = "date string, page string, source string, medium string, sessions bigint, key_events bigint"
    raw = spark.read.option("multiLine", "true").schema(f"property string, timezone string, site_url string, complete boolean, sampled boolean, thresholded boolean, start string, end string, rows array<struct<{row.replace(' string', ':string').replace(' bigint', ':bigint')}>>").json(path).withColumn("export", F.col("_metadata.file_path"))
    rows = raw.select("export", F.explode("rows").alias("r")).select("export", "r.*").withColumn("d", F.to_date("date"))
    return rows, raw.drop("rows")


def sitemap_urls(docs: DataFrame, max_children: int = 50, max_urls: int = 100_000) -> DataFrame:
    """``(sitemap, kind, loc, truncated)`` of sitemap bodies ``(sitemap, body)``: index files are followed one level,
    bodies that are no XML or of another kind are left out."""
    entry = "array<struct<loc: string>>"
    xml = F.from_xml("body", f"url {entry}, sitemap {entry}", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    root = F.regexp_extract("body", r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![^>]*>|\uFEFF)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    kind = F.when(root == "urlset", "urlset").when(root == "sitemapindex", "index").otherwise("unknown")
    parsed = docs.select("sitemap", kind.alias("kind"), F.explode(F.array(xml)).alias("x"))
    entries = F.filter(F.transform(F.when(F.col("kind") == "index", F.col("x.sitemap")).otherwise(F.col("x.url")), lambda e: F.trim(e["loc"])), lambda u: u.isNotNull() & (u != ""))
    rows = parsed.filter("kind != 'unknown'").select("sitemap", "kind", F.posexplode(entries).alias("pos", "loc"))
    children = rows.filter(F.col("kind") == "index").withColumn("cut", F.col("pos") >= max_children)
    own = rows.filter(F.col("kind") == "urlset").select(F.col("sitemap").alias("child"), "pos", F.col("loc").alias("url"))
    links = children.filter("not cut").select("sitemap", F.col("loc").alias("child"), F.col("pos").alias("o1"))
    nested = links.join(own, "child").select("sitemap", F.lit("index").alias("kind"), F.col("url").alias("loc"), "o1", F.col("pos").alias("o2"))
    flat = rows.filter(F.col("kind") == "urlset").select("sitemap", "kind", "loc", F.lit(0).alias("o1"), F.col("pos").alias("o2")).unionByName(nested)
    many = children.groupBy("sitemap").agg(F.bool_or("cut").alias("cut"))
    size = flat.groupBy("sitemap").agg(F.count("*").alias("n"))
    ranked = flat.withColumn("rn", F.row_number().over(Window.partitionBy("sitemap").orderBy("o1", "o2"))).filter(F.col("rn") <= max_urls).join(size, "sitemap")
    return ranked.join(many, "sitemap", "left").select("sitemap", "kind", "loc", (F.coalesce("cut", F.lit(False)) | (F.col("n") > max_urls)).alias("truncated"))
