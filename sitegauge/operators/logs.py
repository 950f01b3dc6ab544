"""Access logs and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sites import keys
from ..functions.urls import path_of
from .prefixes import prefix_hits

#: Crawlers by the name in their user agent, with their role.
BOTS = (
    ("GPTBot", "training_only"), ("OAI-SearchBot", "citation_index"), ("ChatGPT-User", "live_fetch"), ("ClaudeBot", "training_only"),
    ("Claude-SearchBot", "citation_index"), ("Claude-User", "live_fetch"), ("PerplexityBot", "citation_index"), ("Perplexity-User", "live_fetch"),
    ("Google-Extended", "training_only"), ("Applebot-Extended", "training_only"), ("Amazonbot", "citation_index"), ("bingbot", "citation_index"),
    ("BingPreview", "citation_index"), ("Bytespider", "training_only"), ("Meta-ExternalAgent", "training_only"), ("CCBot", "training_only"),
)


def parse_access_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """``ts``: the instant of a Common Log Format line, null where it cannot be read; the line is kept."""
    stamp = F.regexp_extract(col, r"\[(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]", 1)
    return lines.withColumn("ts", F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def mask_ips(col: str) -> Column:
    """IPv4 keeps two octets, IPv6 its first group."""
    v4 = F.regexp_replace(col, rf"(?<![\d.])({_OCTET}\.{_OCTET})\.{_OCTET}\.{_OCTET}(?![\d.])", "$1.x.x")
    # at the start of a line or after a space; a clock time has no empty group and fewer than seven colons
    v6 = r"(?<![^\s])([0-9A-Fa-f]{1,4}):(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){6})[0-9A-Fa-f:]*(?![0-9A-Fa-f:])"
    return F.regexp_replace(F.regexp_replace(v4, r"(?<![^\s])([0-9A-Fa-f]{1,4})::[0-9A-Fa-f:]*(?![0-9A-Fa-f:])", "$1::x"), v6, "$1::x")


def mask_client_ips(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.withColumn(col, mask_ips(col))


def bot_matches(lines: DataFrame, bots: tuple = BOTS, col: str = "line") -> DataFrame:
    """A row per line and known bot that it names; one line may name several."""
    low = F.lower(F.col(col))
    hit = F.filter(F.array(*[F.when(F.contains(low, F.lit(b.lower())), F.lit(b)) for b, _ in bots]), lambda b: b.isNotNull())
    return lines.withColumn("bot", F.explode(hit))


def crawler_hits(lines: DataFrame, bots: tuple = BOTS, col: str = "line", order: str | None = None, samples: int = 2) -> DataFrame:
    """Hits and role of each bot, never-seen ones with 0. With ``order``, a column, also its first lines by it,
    masked and cut to 500 characters, joined by line feeds."""
    spark, by = lines.sparkSession, keys(lines)
    known = spark.createDataFrame(list(bots), "bot string, role string")
    known = lines.select(*by).distinct().crossJoin(F.broadcast(known)) if by else known  # a row for each bot
    found = bot_matches(lines, bots, col)
    out = known.join(found.groupBy(*by, "bot").agg(F.count("*").alias("hits")), [*by, "bot"], "left").na.fill(0, ["hits"])
    if order:
        rank = F.row_number().over(Window.partitionBy(*by, "bot").orderBy(order, col))
        first = found.select(*by, "bot", order, col).withColumn("_rn", rank).filter(F.col("_rn") <= samples).withColumn("_s", F.substring(mask_ips(col), 1, 500))
        first = first.groupBy(*by, "bot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_s"))), lambda s: s["_s"]), "\n").alias("samples"))
        out = out.join(first, [*by, "bot"], "left").na.fill("", ["samples"])
    return out


def generic_bots(lines: DataFrame, bots: tuple = BOTS, col: str = "line") -> DataFrame:
    """Lines that look like a bot's but name no known one."""
    low = F.lower(F.col(col))
    known = F.lit(False)
    for b, _ in bots:
        known = known | F.contains(low, F.lit(b.lower()))
    return lines.filter(~known & low.rlike("bot|spider|crawler"))


def robots_rules(docs: DataFrame) -> DataFrame:
    """``(site, group_id, agent, kind, pattern, pos, crawl_delay)`` of robots.txt bodies: successive user-agent lines share
    a group, one after a rule opens a new group, rules before the first are dropped, blank lines end nothing. Each row
    is a file, read for itself within the row, also where a site has several.

    ``crawl_delay`` is the last valid one of the group. Sitemap lines belong to no group: they have number 0, no agent and
    their address as pattern.
    """
    said = lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))
    read = lambda x, i: F.struct(i.alias("pos"), F.lower(F.trim(F.substring_index(said(x), ":", 1))).alias("field"), F.trim(F.regexp_replace(said(x), "^[^:]*:", "")).alias("value"), F.contains(said(x), F.lit(":")).alias("ok"))
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  # a generator's column is computed once
    files = docs.select("site", once(F.filter(F.transform(F.split("body", r"\r?\n"), read), lambda x: x["ok"]), "all"))
    maps = files.select("site", F.explode(F.filter("all", lambda x: (x["field"] == "sitemap") & (x["value"] != ""))).alias("m"))
    maps = maps.select("site", F.lit(0).cast("bigint").alias("group_id"), F.lit("").alias("agent"), F.lit("sitemap").alias("kind"), F.col("m.value").alias("pattern"), "m.pos", F.lit(None).cast("double").alias("crawl_delay"))
    lines = files.select("site", once(F.filter("all", lambda x: x["field"].isin("user-agent", "allow", "disallow", "crawl-delay")), "lines"))
    agent = lambda x: x["field"] == "user-agent"
    opens = F.transform("lines", lambda x, i: F.when(agent(x) & ~F.coalesce(agent(F.get("lines", i - 1)), F.lit(False)), i))
    starts = lines.select("site", "lines", once(F.filter(opens, lambda i: i.isNotNull()), "starts"))
    groups = starts.select("site", F.posexplode(F.transform("starts", lambda at, g: F.slice("lines", at + 1, F.coalesce(F.get("starts", g + 1), F.size("lines")) - at))).alias("g", "group"))
    delays = F.filter(F.transform(F.filter("group", lambda x: x["field"] == "crawl-delay"), lambda x: x["value"].try_cast("double")), lambda d: d.isNotNull())
    of_group = groups.select("site", (F.col("g") + 1).cast("bigint").alias("group_id"), F.filter("group", lambda x: ~agent(x)).alias("rules"), F.try_element_at(delays, F.lit(-1)).alias("crawl_delay"), F.explode(F.filter("group", agent)).alias("a"))
    rules = of_group.select("site", "group_id", F.lower("a.value").alias("agent"), "crawl_delay", F.explode("rules").alias("r"))
    return rules.select("site", "group_id", "agent", F.col("r.field").alias("kind"), F.col("r.value").alias("pattern"), "r.pos", "crawl_delay").unionByName(maps)


def with_robots_policy(fetches: DataFrame) -> DataFrame:
    s = F.col("status")
    return fetches.withColumn("policy", F.when(s.isNull() | (s < 0) | (s >= 500), "disallow_all").when(s == 200, "parsed").when(s >= 400, "allow_all").otherwise("parsed"))


def rule_regex(pattern: str) -> Column:
    """A robots pattern as a regular expression from the beginning of the path."""
    quoted = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    starred = F.replace(quoted, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\$(?!$)", r"\\\$"))


def _applying(rules: DataFrame, agents: DataFrame, by: list[str]) -> DataFrame:
    """The rules for each ``agent`` of ``agents``: those of all groups that name it, else those of ``*``, on each site for
    itself; ``matched`` tells which."""
    r = rules.select(*by, F.col("agent").alias("_group"), "group_id", "kind", "pattern")
    named = agents.withColumn("_group", F.col("agent")).join(r, [*by, "_group"]).select(*by, "agent", "group_id", "kind", "pattern", F.lit("exact").alias("matched"))
    others = agents.join(named.select(*by, "agent").distinct(), [*by, "agent"], "left_anti").withColumn("_group", F.lit("*"))
    return named.unionByName(others.join(r, [*by, "_group"]).select(*by, "agent", "group_id", "kind", "pattern", F.lit("wildcard").alias("matched")))


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """The longest matching pattern decides, Allow wins ties, empty patterns match nothing, no match allows.
    Groups that name the agent count, else those of ``*``, on each site for itself. Paths meet only patterns whose
    part before the first ``*`` begins them; those are then tried. Each row of ``urls`` has its own, equal ones too."""
    by = keys(urls, rules)
    u = urls.select(*by, "url", path_of("url").alias("path")).distinct()
    r = rules if "group_id" in rules.columns else rules.withColumn("group_id", F.lit(1))
    asked = F.lit(agent.strip().lower()).alias("agent")
    agents = r.select(*by, asked).distinct()
    r = _applying(r, agents, by).filter("kind in ('allow', 'disallow') and pattern != ''").select(*by, "kind", "pattern").distinct()
    r = r.withColumn("prefix", F.regexp_extract("pattern", r"^([^*]*?)(?:\$$|\*.*$|$)", 1)).withColumn("re", rule_regex("pattern"))
    met = prefix_hits(u, r, by).filter(F.rlike("path", F.col("re"))).select(*by, "url", "kind", "pattern")
    none = F.lit(None).cast("string")
    best = met.unionByName(u.select(*by, "url", none.alias("kind"), none.alias("pattern"))).groupBy(*by, "url").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("a")))).alias("kind"))
    return urls.select(*by, "url").join(best, [*by, "url"], "left").select(*by, "url", F.coalesce(F.col("kind") == "allow", F.lit(True)).alias("allowed"))


def crawler_access_audit(rules: DataFrame, bots: tuple = BOTS) -> DataFrame:
    """Per site and known bot: how its rules match, whether the root is blocked and by which rule (the longest
    that matches the root), how many other paths are blocked. Blocked training bots are notes, no findings."""
    by, spark = keys(rules), rules.sparkSession
    r = rules if "group_id" in rules.columns else rules.withColumn("group_id", F.lit(1))
    known = F.broadcast(spark.createDataFrame([(b, role, b.lower()) for b, role in bots], "bot string, role string, agent string"))
    asked = r.select(*by).distinct().crossJoin(known) if by else known
    met = _applying(r, asked.select(*by, "agent"), by)
    root = (F.col("pattern") != "") & F.trim(F.regexp_replace("pattern", r"^[*$]+|[*$]+$", "")).isin("", "/")
    size = lambda kind: F.max(F.when(root & (F.col("kind") == kind), F.length("pattern")))
    off = F.col("kind") == "disallow"
    per = met.groupBy(*by, "agent").agg(
        F.max("matched").alias("matched"), size("disallow").alias("_off"), size("allow").alias("_on"),
        F.max_by(F.when(root & off, F.col("pattern")), F.when(root & off, F.struct(F.length("pattern"), "pattern"))).alias("_rule"),
        F.count_distinct(F.when(off & ~root & (F.col("pattern") != ""), F.col("pattern"))).alias("_paths"),
    )
    rows = asked.join(per, [*by, "agent"], "left")
    blocked = F.coalesce(F.col("_off") > F.coalesce("_on", F.lit(0)), F.lit(False))
    paths = F.when(blocked, 0).otherwise(F.coalesce("_paths", F.lit(0))).cast("bigint")
    note = F.col("role") == "training_only"
    sev = F.when(blocked & note, "info").when(blocked, "high").when((paths > 0) & ~note, "medium").otherwise("none")
    return rows.select(*by, "bot", F.coalesce("matched", F.lit("none")).alias("matched"), blocked.alias("root_blocked"), F.when(blocked, F.col("_rule")).otherwise("").alias("blocking_rule"), paths.alias("blocked_patterns"), sev.alias("severity"))


def unknown_agents(rules: DataFrame, bots: tuple = BOTS) -> DataFrame:
    return rules.filter(~F.col("agent").isin("", "*", *[b.lower() for b, _ in bots])).select(*keys(rules), "agent").distinct()
