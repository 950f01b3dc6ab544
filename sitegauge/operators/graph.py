"""Link graphs: edges, aliases, depths, orphans. Inputs with a ``site`` column hold many sites, whose pages never meet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sites import keys
from ..functions.urls import url_key
from ..sources.tables import checkpointed, scratch_path


def alias_map(pages: DataFrame) -> DataFrame:
    """Requested key -> final key where they differ; errors are skipped, the last fetched wins."""
    rows = pages.filter((F.coalesce("error_type", F.lit("")) == "") & (F.coalesce("status", F.lit(0)) >= 0) & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("final_url", F.lit("")) != ""))
    by = keys(pages)
    rows = rows.select(*by, url_key("url").alias("src"), url_key("final_url").alias("dst"), "fetch_seq").filter("src != '' and dst != '' and src != dst")
    return rows.groupBy(*by, "src").agg(F.max_by("dst", "fetch_seq").alias("dst"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, max_hops: int = 5, key: str = "key") -> DataFrame:
    """``target``: the end of each key's alias chain, at most ``max_hops`` hops, never back to a seen key."""
    by = keys(names, aliases)
    a = aliases.select(*by, F.col("src").alias("target"), F.col("dst").alias("_dst"))
    out = names.withColumn("target", F.col(key)).withColumn("_seen", F.array(key)).withColumn("_stop", F.lit(False))
    for _ in range(max_hops):
        out = out.join(a, [*by, "target"], "left")
        move = ~F.col("_stop") & F.col("_dst").isNotNull() & ~F.array_contains("_seen", F.col("_dst"))
        out = out.select(*names.columns, (~move).alias("_stop"), F.when(move, F.col("_dst")).otherwise(F.col("target")).alias("target"), F.when(move, F.array_append("_seen", F.col("_dst"))).otherwise(F.col("_seen")).alias("_seen"))
    return out.select(*names.columns, "target")


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct edges between final keys, link targets folded into what they redirect to; no loops, no error pages."""
    fine, by = pages.filter((F.coalesce("error_type", F.lit("")) == "") & (F.coalesce("status", F.lit(0)) >= 0)), keys(pages)
    raw = fine.select(*by, url_key(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))).alias("src"), F.explode("internal_links").alias("link")).select(*by, "src", url_key("link").alias("key")).distinct()
    return resolve_aliases(raw, alias_map(pages)).select(*by, "src", F.col("target").alias("dst")).filter("src != dst and dst != ''").distinct()


def inbound_counts(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy(*keys(edges), "dst").agg(F.count("*").alias("inbound"))


#: Edges of one bucket, at least, while there are fewer buckets than shuffle partitions.
BUCKET = 250_000


def link_depths(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, depth)`` of all nodes reachable from ``roots(node)``; a root that no edge knows has a null depth.

    Edges are bucketed by their source and reached nodes by themselves, in tables that are written once: a round
    shuffles its frontier to the edges and its finds to the nodes, so what it moves grows with those and not
    with what was reached before. Its new nodes are one more partition of the table.
    """
    spark, by = edges.sparkSession, keys(edges, roots)
    edges = checkpointed(edges.select(*by, "src", "dst").distinct(), "edges")
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // BUCKET))
    known = edges.select(*by, F.col("src").alias("node")).union(edges.select(*by, "dst"))
    start = checkpointed(roots.select(*by, "node").distinct(), "roots")
    kind = ", ".join(f"{c} {dict(roots.dtypes)[c]}" for c in [*by, "node"])
    path, names = scratch_path(spark, "depths"), [f"sitegauge_{uuid.uuid4().hex}" for _ in range(2)]

    def reach(nodes: DataFrame, depth: int) -> None:
        _bucketed(nodes.select(*by, "node", F.lit(depth).alias("depth")), names[1], path, buckets, [*by, "node"], "depth")

    try:
        _bucketed(edges.repartition(buckets, *by, "src"), names[0], scratch_path(spark, "links"), buckets, [*by, "src"])
        reach(start.join(known, [*by, "node"], "left_semi").repartition(buckets, *by, "node"), 0)
        for depth in range(1, max_rounds):
            reach(next_nodes(spark.table(names[0]), spark.table(names[1]), depth, by, buckets), depth)
            if spark.table(names[1]).filter(F.col("depth") == depth).isEmpty():
                lost = start.join(known, [*by, "node"], "left_anti").withColumn("depth", F.lit(None).cast("int"))
                return spark.read.schema(f"{kind}, depth int").parquet(path).unionByName(lost)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone: the result reads the files
    raise RuntimeError(f"deeper than {max_rounds} clicks")


def next_nodes(links: DataFrame, reached: DataFrame, depth: int, by: list[str], buckets: int) -> DataFrame:
    """Nodes that links lead to from those of the depth before and that were not reached yet, dealt to the buckets."""
    front = reached.filter(F.col("depth") == depth - 1).select(*by, F.col("node").alias("src")).repartition(buckets, *by, "src")
    found = links.join(front, [*by, "src"]).select(*by, F.col("dst").alias("node")).repartition(buckets, *by, "node").distinct()
    return found.join(reached.drop("depth"), [*by, "node"], "left_anti")


def _bucketed(rows: DataFrame, name: str, path: str, buckets: int, columns: list[str], *parts: str) -> None:
    """Append rows that are dealt to the buckets already to a table of files below ``path``."""
    writer = rows.write.mode("append").format("parquet").option("path", path).bucketBy(buckets, *columns)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)


def depth_histogram(depths: DataFrame) -> DataFrame:
    return depths.groupBy(*keys(depths), "depth").agg(F.count("*").alias("pages"))


def orphan_pages(universe: DataFrame, depths: DataFrame, pages: DataFrame, nodes: DataFrame | None = None, truncated: bool = False) -> DataFrame:
    """Known pages that no click reaches: crawled and indexable ones are orphans, uncrawled ones candidates.
    Refused (one row for the site) where its universe is empty or more than twice its ``nodes`` (those of ``depths`` by default)."""
    by = keys(universe, depths, pages)
    graph = (depths if nodes is None else nodes).select(*by, "node").distinct()
    sizes = universe.select(*by, "node").distinct().groupBy(*by).agg(F.count("*").alias("n")) if by else universe.select("node").distinct().agg(F.count("*").alias("n"))
    known = graph.groupBy(*by).agg(F.count("*").alias("m")) if by else graph.agg(F.count("*").alias("m"))
    sizes = sizes.join(known, by, "full_outer") if by else sizes.crossJoin(known)  # one row each without a site
    sizes = sizes.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    reason = F.when(F.col("n") == 0, "no independent list of pages").when(F.col("n") > 2 * F.col("m"), "the list of pages is more than twice the crawl")
    sizes = sizes.withColumn("_reason", reason)
    refused = sizes.filter("_reason is not null").select(*by, F.lit("").alias("node"), F.lit("refused").alias("type"), F.lit("info").alias("severity"), F.col("_reason").alias("reason"))
    fine = sizes.filter("_reason is null").select(*by, F.lit(True).alias("_fine"))
    left = universe.select(*by, "node").distinct().join(depths.filter("depth is not null"), [*by, "node"], "left_anti").join(pages.select(*by, "node", "indexable"), [*by, "node"], "left")
    left = left.join(fine, by) if by else left.crossJoin(F.broadcast(fine))
    crawled = F.col("indexable").isNotNull()
    rows = left.filter(~crawled | F.col("indexable"))
    return rows.select(*by, F.col("node").cast("string").alias("node"), F.when(crawled, "orphan_page").otherwise("orphan_candidate").alias("type"), F.when(F.lit(truncated) | ~crawled, "low").otherwise("high").alias("severity"), F.lit("").alias("reason")).unionByName(refused)


def url_universe(*sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct folded URLs of all sources ``(source, url)``, and the number each source gives."""
    rows, by = sources[0], keys(*sources)
    for s in sources[1:]:
        rows = rows.unionByName(s)
    keyed = rows.select(*by, "source", url_key("url").alias("node")).filter("node != ''").distinct()
    return keyed.select(*by, "node").distinct(), keyed.groupBy(*by, "source").agg(F.count("*").alias("urls"))


def link_graph_audit(nodes: DataFrame, depths: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """Indexable pages that are unreachable, too deep or linked once."""
    by = keys(nodes, depths, edges)
    rows = nodes.filter("indexable").join(depths, [*by, "node"], "left").join(inbound_counts(edges).withColumnRenamed("dst", "node"), [*by, "node"], "left")
    made = F.array(
        F.when(F.col("depth").isNull(), F.struct(F.lit("unreachable").alias("type"), F.lit("high").alias("severity"))),
        F.when(F.col("depth") > max_depth, F.struct(F.lit("too_deep").alias("type"), F.lit("medium").alias("severity"))),
        F.when((F.col("inbound") == 1) & (F.col("depth") > 0), F.struct(F.lit("single_inbound").alias("type"), F.lit("low").alias("severity"))),
    )
    return rows.select(*by, "node", F.explode(F.filter(made, lambda f: f.isNotNull())).alias("f")).select(*by, "node", "f.*")


def first_joined(rows: DataFrame, by: list[str], col: str, n: int, name: str) -> DataFrame:
    """The ``n`` least values of ``col`` for each key, joined by commas: ranked first, so that no more are gathered."""
    top = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(col))).filter(F.col("_rn") <= n)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(col).cast("string").alias("v")))), lambda s: s["v"]), ",").alias(name))


def broken_internal_links(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Targets that answer 400 or more, with their number of linking pages and the first twenty."""
    by = keys(edges, status)
    bad = status.filter("status >= 400").select(*by, F.col("node").alias("dst"), "status")
    rows, own = edges.select(*by, "src", "dst").distinct().join(bad, [*by, "dst"]), [*by, "dst", "status"]
    counted = rows.groupBy(*own).agg(F.count("*").alias("linkers")).join(first_joined(rows, own, "src", 20, "first_linkers"), own)
    return counted.withColumn("severity", F.when(F.col("status") >= 500, "high").otherwise("medium"))


def links_to_redirects(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """Edges to pages that redirected with a substantive hop."""
    by = keys(edges, redirects)
    return edges.join(redirects.select(*by, F.col("src").alias("dst"), F.col("dst").alias("landing")), [*by, "dst"]).select(*by, "src", "dst", "landing")
