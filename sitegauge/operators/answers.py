"""Mentions and citations in AI answers, with honest intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wilson
from ..functions.urls import url_key


def blanked(col: str = "text") -> Column:
    """Addresses blanked; labels of Markdown links stay unless they look like an address."""
    t = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\[(?!https?://|www\.)([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]\([^)]*\)", " "), r"(?i)\b(?:https?://|www\.)\S+", " ")


def brand_mentions(answers: DataFrame, entities: dict[str, list[str]], keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Per answer and entity ``(mentioned, n, first_position)``; longest alias first, case-insensitive, whole words."""
    rows = answers.withColumn("_t", blanked())
    facts = []
    for name, aliases in entities.items():
        fit = sorted((a for a in aliases if len(a) >= 2), key=lambda a: (-len(a), a))
        pattern = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(a) for a in fit) + r")(?![A-Za-z0-9])" if fit else "(?!)"
        n = F.regexp_count("_t", F.lit(pattern))
        at = F.when(n > 0, F.round((F.regexp_instr("_t", F.lit(pattern)) - 1) / F.greatest(F.char_length("_t"), F.lit(1)), 4)).otherwise(-1.0)
        facts.append(F.struct(F.lit(name).alias("entity"), (n > 0).alias("mentioned"), n.cast("bigint").alias("n"), at.alias("first_position")))
    return rows.select(*keys, F.explode(F.array(*facts)).alias("m")).select(*keys, "m.*")


def with_wilson_rate(counts: DataFrame, hits: str, trials: str) -> DataFrame:
    return counts.withColumn("_w", wilson(F.col(hits), F.col(trials))).select(*counts.columns, "_w.rate", "_w.low", "_w.high")


def _runs(rows: DataFrame) -> list[str]:
    return ["run"] if "run" in rows.columns else []


def mention_stats(mentions: DataFrame, brand: str) -> DataFrame:
    """Per entity (of each ``run``, if there is that column): answers that mention it with interval, total mentions, share of voice,
    mean prominence, and of the answers that mention it the share that ``recommended`` it and (positive - negative)
    by ``sentiment``; the brand first, then by share."""
    by, has = _runs(mentions), mentions.columns
    hit = F.col("mentioned")
    liked = F.count_if(hit & F.coalesce("recommended", F.lit(False))) if "recommended" in has else F.lit(0)
    mood = F.sum(F.when(hit, F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1).otherwise(0))) if "sentiment" in has else F.lit(0)
    rows = mentions.groupBy(*by, "entity").agg(F.count_if(hit).alias("mentioned"), F.count("*").alias("answers"), F.sum("n").alias("total"), F.round(F.avg(F.when(hit & (F.col("first_position") >= 0), 1 - F.col("first_position"))), 4).alias("prominence"), liked.alias("_liked"), mood.alias("_mood"))
    all_ = rows.groupBy(*by).agg(F.sum("total").alias("_all"))
    rows = rows.join(all_, by) if by else rows.crossJoin(F.broadcast(all_))  # one row
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    rows = rows.withColumns({"share": share("total", "_all"), "recommend_rate": share("_liked", "mentioned"), "sentiment_score": share("_mood", "mentioned")}).drop("_all", "_liked", "_mood")
    return with_wilson_rate(rows, "mentioned", "answers").withColumn("is_brand", F.col("entity") == brand).orderBy(*by, F.desc("is_brand"), F.desc("share"), "entity")


def measurement_verdict(mentions: DataFrame, brand: str, keys: tuple[str, ...] = ("conv_id", "turn"), runs: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """What each run can claim about its subject: ``(verdict, n, hits, informative)``.

    The sample is thin below ten answers, or if even the upper bound of the share of answers that mention
    anyone is under ``least``. ``runs(run)`` are the runs that were meant to be: without answers they have no data.
    """
    by = _runs(mentions)
    answers = mentions.groupBy(*by, *keys).agg(F.bool_or("mentioned").alias("any"), F.bool_or(F.col("mentioned") & (F.col("entity") == brand)).alias("own"), F.count_distinct("entity").alias("entities"))
    per = answers.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("own").alias("hits"), F.count_if("any").alias("informative"), F.max("entities").alias("entities"))
    per = per if runs is None else runs.select(*by).distinct().join(per, by, "left").na.fill(0, ["n", "hits", "informative"])
    high = wilson(F.col("informative"), F.col("n"))["high"]
    v = F.when(F.col("n") == 0, "no-data").when(F.col("entities") <= 1, "no-competitors").when((F.col("n") < 10) | (high < least), "thin-sample").when(F.col("hits") == 0, "sampled-absence").otherwise("sampled-presence")
    return per.select(*by, v.alias("verdict"), "n", "hits", "informative")


def mentions_by_prompt(mentions: DataFrame, brand: str, prompt: str = "conv_id") -> DataFrame:
    """Rates per prompt and entity; a rival wins on ten answers or more if its lower bound is above the brand's upper."""
    per = with_wilson_rate(mentions.groupBy(prompt, "entity").agg(F.count_if("mentioned").alias("hits"), F.count("*").alias("answers")), "hits", "answers")
    own = F.col("entity") == brand
    return per.groupBy(prompt).agg(F.max("answers").alias("answers"), F.max(F.when(own, F.col("rate"))).alias("brand_rate"), F.max(F.when(own, F.col("high"))).alias("brand_high"), F.max(F.when(~own, F.col("rate"))).alias("rival_rate"), F.max(F.when(~own, F.col("low"))).alias("rival_low"), F.max_by(F.when(~own, F.col("entity")), F.when(~own, F.struct("rate", "entity"))).alias("rival")).withColumn("rival_wins", (F.col("answers") >= 10) & (F.col("rival_low") > F.col("brand_high")))


def citation_gaps(by_prompt: DataFrame) -> DataFrame:
    gap = F.round(F.col("rival_rate") - F.col("brand_rate"), 4)
    return by_prompt.filter("rival_rate > brand_rate").select("conv_id", "rival", gap.alias("gap")).orderBy(F.desc("gap"), "conv_id")


def citations_by_page(citations: DataFrame, answers: int, n: int = 30) -> DataFrame:
    """Answers that cite each page, once per answer."""
    rows = citations.select("sample_id", "url").distinct().groupBy("url").agg(F.count("*").alias("answers"))
    return rows.withColumn("rate", F.round(F.col("answers") / answers, 4)).orderBy(F.desc("answers"), "url").limit(n)


_RUN = ["run_date", "prompt_id", "provider"]
_VALID = "outcome IN ('cited', 'not_cited')"


def vote_samples(samples: DataFrame, target: str = "") -> DataFrame:
    """Samples ``(run_date, prompt_id, provider, sample_id, outcome, citations)`` folded per (run, prompt, provider).

    Only samples that were configured and free of errors are valid: a majority is half of those, rounded up.
    ``citation_urls`` are the valid samples' citations of ``target``, one for each identity, sorted.
    """
    counts = F.count_if(F.expr(_VALID)).alias("valid"), F.count_if(F.col("outcome") == "cited").alias("cited"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") != "not_configured").alias("on")
    rows = samples.groupBy(*_RUN).agg(*counts)
    state = F.when(F.col("on") == 0, "not_configured").when(F.col("valid") == 0, "error").when(F.col("cited") == 0, "not_cited").when(F.col("cited") >= F.ceil(F.col("valid") / 2), "cited").otherwise("mixed")
    rows = rows.select(*_RUN, "valid", "cited", "errors", state.alias("state"))
    none = F.array().cast("array<string>")
    if "citations" not in samples.columns:
        return rows.withColumn("citation_urls", none)
    urls = cited_identities(samples, target).groupBy(*_RUN).agg(F.array_sort(F.collect_list("identity")).alias("citation_urls"))
    return rows.join(urls, _RUN, "left").withColumn("citation_urls", F.coalesce("citation_urls", none))


def cited_identities(samples: DataFrame, target: str) -> DataFrame:
    """``(run_date, prompt_id, provider, key, identity)``: what valid samples cite of the target's host or its subdomains.

    A citation is known by its address if that is the target's, else by its title (some assistants cite
    redirects that change with each run and carry the domain as title). Of equal keys the first one stays, by
    sample, then by place.
    """
    own = F.lit(re.sub(r"^www\.", "", target.lower()))
    within = lambda host: (host != "") & ((host == own) | host.endswith(F.concat(F.lit("."), own)))
    folded = lambda c: F.regexp_replace(F.regexp_replace(F.when(F.contains(c, F.lit("//")), F.lower(F.regexp_extract(c, "//([^/?#]*)", 1))).otherwise(F.lower(c)), r"^www\.", ""), "/+$", "")
    cited = samples.filter(_VALID).select(*_RUN, "sample_id", F.posexplode("citations").alias("pos", "c"))
    cited = cited.select(*_RUN, "sample_id", "pos", F.trim(F.coalesce("c.url", F.lit(""))).alias("url"), F.trim(F.coalesce("c.title", F.lit(""))).alias("title"))
    at_url = within(folded(F.col("url")))
    identity = F.when(at_url & F.contains("url", F.lit("//")), F.col("url")).otherwise(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url")))
    rows = cited.filter(at_url | within(folded(F.col("title")))).withColumn("identity", identity).withColumn("key", url_key("identity"))
    return rows.groupBy(*_RUN, "key").agg(F.min_by("identity", F.struct("sample_id", "pos")).alias("identity"))
