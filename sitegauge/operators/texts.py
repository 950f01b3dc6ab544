"""Similarity joins over topics and pages, overlap and evidence checks over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import headings, links, ngrams, numbers, plain_words, terms
from ..sources.tables import checkpointed
from .pages import first_by
from .similar import index, nearest, similar


def text_terms(df: DataFrame, col: str = "text", by: str = "doc_id", profile: str = "topic") -> DataFrame:
    """``(by, term, n)`` of a profile of ``functions.text``; the metadata profile is a set, so n is 1."""
    found = terms(col, profile)
    rows = df.select(by, F.explode(F.array_distinct(found) if profile == "metadata" else found).alias("term"))
    return rows.groupBy(by, "term").agg(F.count("*").alias("n"))


def document_facts(docs: DataFrame) -> DataFrame:
    """Counts of words, links, headings and numbers per document."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size(plain_words(t)).alias("words"), F.size(links(t)).alias("links"), F.size(headings(t)).alias("headings"), F.size(F.array_distinct(numbers(t))).alias("numbers"), F.size(F.filter(F.split(t, r"[.!?]+\s+"), lambda s: F.trim(s) != "")).alias("sentences"))


def doc_sentences(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, sentence)``: a sentence ends before space that follows a stop and precedes a capital, digit, quote or bracket."""
    cut = F.split(F.trim(F.coalesce("text", F.lit(""))), r"(?<=[.!?])\s+(?=[A-Z\"“(\[$0-9])")
    return docs.select("doc_id", F.posexplode(F.filter(cut, lambda x: x != "")).alias("pos", "sentence"))


#: A figure with its unit, and a range of two.
_FIGURE = r"\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|billion|million|thousand|bn|m\b|k\b)?"
STATISTIC = rf"(?i){_FIGURE}(?:\s*(?:to|-|–|—)\s*{_FIGURE})?"


def doc_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, rank, token)``: figures worth a source, each once, longest first: money, percentages, units, ranges and large
    numbers; bare years and bare integers of up to three digits are none."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(STATISTIC), F.lit(0)), lambda m: F.regexp_replace(F.trim(m), r"[.,;:]+$", ""))
    bare = lambda m: F.trim(F.regexp_replace(m, r"[$,]", ""))
    plain = lambda m: ~m.rlike(r"[$%A-Za-z]") & bare(m).rlike(r"^(?:(?:19|20)\d\d|\d{1,3})$")
    rows = docs.select("doc_id", F.posexplode(F.array_distinct(F.filter(found, lambda m: (m != "") & ~plain(m)))).alias("pos", "token"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.char_length("token")), "pos")).alias("rank"), "token")


def doc_links(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(links("text")).alias("l")).select("doc_id", "l.label", "l.url")


def weighted_terms(df: DataFrame, by: str, **weights: int) -> DataFrame:
    """``(by, term, w)``: link terms of several columns, counted times their weights."""
    parts = [F.transform(terms(c, "link"), _weigh(n)) for c, n in weights.items()]
    return df.select(by, F.explode(F.concat(*parts)).alias("t")).select(by, "t.*").groupBy(by, "term").agg(F.sum("w").alias("w"))


def _weigh(n: int):
    return lambda t: F.struct(t.alias("term"), F.lit(n).alias("w"))


#: Weights of a keyword's priority in a competitor's topic.
PRIORITY = {"high": 1.0, "medium": 0.7, "low": 0.4}


def competitor_signal(topics: DataFrame, competitor_topics: DataFrame, least: float = 0.5) -> DataFrame:
    """For each topic ``(a, title, source)`` the largest cosine with a competitor's ``(b, title, priority)``, times
    the weight of its priority; 1 for topics that came from a competitor, 0 without any."""
    one, two = index(*(text_terms(t, "title", k).withColumnRenamed("n", "w") for t, k in ((topics, "a"), (competitor_topics, "b"))))
    weight = F.coalesce(*[F.when(F.col("priority") == k, F.lit(v)) for k, v in PRIORITY.items()], F.lit(0.7))
    best = _best_of_matches(one, two, competitor_topics.select("b", weight.alias("weight")), least, F.col("score") * F.col("weight"))
    signal = F.when(F.col("source") == "competitor", 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0))))
    return topics.select("a", "source").join(best, "a", "left").select("a", F.round(signal, 4).alias("signal"))


def geo_signal(topics: DataFrame, gaps: DataFrame, least: float = 0.4) -> DataFrame:
    """For each topic ``(a, title, keyword)`` the largest gap among the AI-answer prompts ``(b, text, gap)`` that it
    matches; a null or zero gap counts as 0.5."""
    both = topics.select("a", F.concat_ws(" ", "title", F.coalesce("keyword", F.lit(""))).alias("text"))
    one, two = index(*(text_terms(t, "text", k).withColumnRenamed("n", "w") for t, k in ((both, "a"), (gaps, "b"))))
    gap = F.least(F.lit(1.0), F.coalesce(F.when(F.col("gap") != 0, F.col("gap")), F.lit(0.5)))
    best = _best_of_matches(one, two, gaps.select("b", gap.alias("weight")), least, F.col("weight"))
    return topics.select("a").join(best, "a", "left").select("a", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("signal"))


def _best_of_matches(one: DataFrame, two: DataFrame, weights: DataFrame, least: float, value: Column) -> DataFrame:
    """``(a, best)``: the largest ``value`` over all matches; of equal vectors only the largest of ``weights(b, weight)`` counts."""
    per_class = two.select("b", F.col("cls").alias("cb")).join(weights, "b").groupBy("cb").agg(F.max("weight").alias("weight"))
    best = similar(one, two, least).join(per_class, "cb").groupBy("ca").agg(F.max(value).alias("best"))
    return one.select("a", F.col("cls").alias("ca")).join(best, "ca").select("a", "best")


def near_duplicate_topics(new: DataFrame, existing: DataFrame, least: float = 0.6) -> DataFrame:
    """New topics ``(a, title)`` with an existing one ``(b, title)`` of at least that cosine, and the nearest."""
    one, two = index(*(text_terms(t, "title", k).withColumnRenamed("n", "w") for t, k in ((new, "a"), (existing, "b"))))
    sizes = two.groupBy(F.col("cls").alias("cb")).agg(F.min("b").alias("b"), F.count("*").alias("n"))
    hits = similar(one, two, least).withColumn("score", F.round("score", 4)).join(sizes, "cb")
    best = hits.groupBy("ca").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m"), F.sum("n").alias("matches"))
    return one.select("a", F.col("cls").alias("ca")).join(best, "ca").select("a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("score"), "matches")


def best_match(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each text ``(a, title)`` the candidate of largest cosine; the first candidate wins ties; null without any."""
    one, two = index(*(text_terms(t, "title", k).withColumnRenamed("n", "w") for t, k in ((texts, "a"), (candidates, "b"))))
    return texts.select("a").join(nearest(one, two, 1, 1e-9), "a", "left")


def link_candidates(targets: DataFrame, pages: DataFrame, k: int = 5, least: float = 0.08, n_terms: int = 12) -> DataFrame:
    """Top k other pages per target by cosine of weighted terms of title, h1, h2 and og, ordered by the rounded
    score, then id; ``shared`` are the first shared terms by product of their weights, then by name."""
    weights = {"title": 3, "h1": 3, "h2": 1, "og": 1}
    va, vb = weighted_terms(targets, "a", **weights), weighted_terms(pages, "b", **weights)
    rows = nearest(*index(va, vb), k + 1, least).filter("a != b")  # one more than k, as a page is its own nearest
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= k)
    met = top.select("a", "b").join(va.withColumnRenamed("w", "wa"), "a").join(vb.withColumnRenamed("w", "wb"), ["b", "term"])
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("wa") * F.col("wb")).alias("p"), "term"))), 1, n_terms)
    shared = met.groupBy("a", "b").agg(F.array_join(F.transform(best, lambda t: t["term"]), " ").alias("shared"))
    return top.join(shared, ["a", "b"])


def ngram_overlap(docs: DataFrame, corpus: DataFrame, n: int = 12, most: int = 20) -> DataFrame:
    """``(doc_id, item_id, phrase)``: exact overlap of n words with a passage; one phrase per pair, the least, and
    the first ``most`` passages of a document.

    Runs travel as two 64-bit hashes. Those of the passages are written first, so their size is known when the join is
    planned: below Spark's broadcast threshold the documents' runs are probed where they are made and none is shuffled.
    """

    def hashed(df: DataFrame, k: str, *more: str) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
        once = df.select(k, F.explode(F.array(tokens)).alias("t")).filter(F.size("t") >= n)  # a generator's column is computed once
        runs = once.select(k, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.slice("t", i, n))).alias("g"))
        return runs.select(k, F.xxhash64("g").alias("h"), F.xxhash64(F.lit(1), "g").alias("h2"), *[F.array_join("g", " ").alias(c) for c in more])

    items = checkpointed(hashed(corpus, "item_id", "phrase").distinct(), "runs")
    known = checkpointed(items.select("h", "h2").distinct(), "known")
    met = hashed(docs, "doc_id").join(known, ["h", "h2"], "left_semi").distinct()
    met = met.join(items, ["h", "h2"]).groupBy("doc_id", "item_id").agg(F.min("phrase").alias("phrase"))
    return met.withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id"))).filter(F.col("_rn") <= most).drop("_rn")


def _squeezed(col: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", " "))


def verify_passages(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each passage ``(source_id, passage, sha)`` stands in its source ``(source_id, body)`` of that hash."""
    rows = passages.join(sources, "source_id", "left")
    return rows.select("source_id", F.coalesce(F.contains(_squeezed("body"), _squeezed("passage")), F.lit(False)).alias("found"), F.coalesce(F.sha2("body", 256) == F.col("sha"), F.lit(False)).alias("hash_ok"))


def checked_quotes(points: DataFrame, sources: DataFrame) -> DataFrame:
    """``points(source_id, quote, ..)`` with ``verified``: whether the quote stands in its source, compared as runs of ``[a-z0-9$%.,]``."""
    norm = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[a-z0-9$%.,]+"), F.lit(0)), " ")
    rows = points.withColumn("_q", norm("quote")).join(sources.select("source_id", norm("body").alias("_b")), "source_id", "left")
    return rows.withColumn("verified", F.coalesce((F.col("_q") != "") & F.contains("_b", F.col("_q")), F.lit(False))).drop("_q", "_b")


def verify_quotes(points: DataFrame, sources: DataFrame) -> DataFrame:
    """Kept and dropped quotes per source."""
    return checked_quotes(points, sources).groupBy("source_id").agg(F.count_if("verified").alias("kept"), F.count_if(~F.col("verified")).alias("dropped"))


def quote_trail(points: DataFrame, sources: DataFrame) -> DataFrame:
    """The trail of each source of ``sources(source_id, url, title, body)``: its kept quotes of ``points(source_id, pos, quote)``
    in order, a row each; a source without any has one row and no quote."""
    kept = checked_quotes(points, sources).filter("verified").select("source_id", "pos", "quote")
    rank = F.when(F.col("quote").isNotNull(), F.row_number().over(Window.partitionBy("source_id").orderBy("pos", "quote")))
    return sources.select("source_id", "url", "title").join(kept, "source_id", "left").select("source_id", "url", "title", rank.alias("rank"), "quote")


def verify_numbers(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbers of a document that its sources ``(doc_id, body)`` do not hold, with or without percent."""
    own = docs.select("doc_id", F.explode(F.array_distinct(numbers("text"))).alias("number")).withColumn("bare", F.regexp_replace("number", "%$", ""))
    known = sources.select("doc_id", F.explode(F.array_distinct(F.transform(numbers("body"), lambda x: F.regexp_replace(x, "%$", "")))).alias("bare"))
    return own.join(known, ["doc_id", "bare"], "left_anti").select("doc_id", "number")


def repetitive_text(docs: DataFrame) -> DataFrame:
    """Documents with fewer distinct words than min(10, max(1, words / 10))."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \n\t\r]+"), lambda x: x != "")
    n, own = F.size(w), F.size(F.array_distinct(w))
    return docs.select("doc_id", n.alias("words"), own.alias("distinct_words")).filter(F.col("distinct_words") < F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("words") / 10))))


def rewrite_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a rewrite lost or added: numbers, links, headings, length outside 0.7 to 1.4."""
    rows = before.select("doc_id", F.col("text").alias("old")).join(after.select("doc_id", F.col("text").alias("new")), "doc_id")
    size = lambda a, b: F.size(F.array_except(a, b))
    urls = lambda c: F.transform(links(c), lambda x: x["url"])
    ratio = F.round(F.size(plain_words("new")) / F.greatest(F.size(plain_words("old")), F.lit(1)), 4)
    return rows.select(
        "doc_id", size(numbers("old"), numbers("new")).alias("numbers_lost"), size(numbers("new"), numbers("old")).alias("numbers_added"), size(urls("old"), urls("new")).alias("links_lost"), size(urls("new"), urls("old")).alias("links_added"),
        (~headings("old").eqNullSafe(headings("new"))).alias("headings_changed"), ratio.alias("length_ratio"),
    ).withColumn("length_ok", F.col("length_ratio").between(0.7, 1.4))


#: Phrases of relative time, version strings, and what tells prices and ratings near them.
RELATIVE_TIME = r"(?i)\b(?:last year|this year|next year|earlier this year|as of \d{4}|currently in \d{4}|in \d{4} so far)\b"
VERSION = r"(?i:\b(?:version|ver\.?|v)\s?\d+(?:\.\d+){1,3}\b)|\b[A-Z][A-Za-z0-9+#.]{1,20}\s+\d+\.\d+(?:\.\d+)?\b"
PRICE_OR_RATING = ("$", "€", "£", "rated", "stars", "out of", "price", "per month")


def _found(text: str, pattern: str, kind: str) -> Column:
    """``(kind, phrase, start)`` of all matches; they are marked in the text, which is then cut at the marks."""
    parts = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "\u0001")
    clean = F.transform(parts, lambda p: F.replace(p, F.lit("\u0002"), F.lit("")))
    ends = F.aggregate(clean, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.char_length(p)))
    made = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), F.substring_index(p, "\u0002", 1).alias("phrase"), F.get(ends, i).alias("start")))
    return F.slice(made, 2, F.greatest(F.size(made) - 1, F.lit(0)))


def staleness_phrases(pages: DataFrame, year: int, col: str = "text", around: int = 60, guard: int = 20, marks: tuple[str, ...] = PRICE_OR_RATING) -> DataFrame:
    """``(page_id, kind, phrase, context)``: past years, relative-time phrases, past copyright years, versions, with
    ``around`` characters of context on both sides. Versions within ``guard`` characters of a price or rating, told by the
    lower-case ``marks``, are left out."""
    rows = pages.select("page_id", F.translate(F.coalesce(F.col(col), F.lit("")), "\u0001\u0002", "  ").alias("_t"))
    kinds = [_found("_t", r"\b20[0-9]{2}\b", "hardcoded_year"), _found("_t", RELATIVE_TIME, "relative_time_phrase"), _found("_t", r"(?i)(?:©|\(c\)|copyright)\s*20[0-9]{2}", "copyright_year"), _found("_t", VERSION, "version_reference")]
    rows = rows.select("page_id", "_t", F.explode(F.concat(*kinds)).alias("m")).select("page_id", "_t", "m.*")
    window = lambda n: F.substring("_t", F.greatest(F.col("start") - n, F.lit(0)) + 1, F.char_length("phrase") + n + F.least(F.col("start"), F.lit(n)))
    priced = F.lit(False)
    for mark in marks:
        priced = priced | F.contains(F.lower(window(guard)), F.lit(mark))
    dated = F.col("kind").isin("hardcoded_year", "copyright_year")
    ok = F.when(dated, F.substring("phrase", -4, 4).cast("int") < year).when(F.col("kind") == "version_reference", ~priced).otherwise(True)
    return rows.filter(ok).select("page_id", "kind", "phrase", F.trim(window(around)).alias("context"))


def boilerplate_matches(matches: DataFrame, n_pages: int) -> DataFrame:
    """Phrases on at least five pages and on more than half of them are template text."""
    return matches.groupBy("kind", "phrase").agg(F.count_distinct("page_id").alias("pages")).filter((F.col("pages") >= 5) & (F.col("pages") > 0.5 * n_pages))


def stale_candidates(unchanged: DataFrame, matches: DataFrame, boilerplate: DataFrame, inbound: DataFrame) -> DataFrame:
    """Unchanged pages that keep matches beside template text, by number of signals, then by inbound links."""
    own = matches.join(boilerplate, ["kind", "phrase"], "left_anti").groupBy("page_id").agg(F.count("*").alias("signals"))
    rows = own.join(unchanged.select("page_id"), "page_id", "left_semi").join(inbound.withColumnRenamed("dst", "page_id"), "page_id", "left").na.fill(0, ["inbound"])
    return rows.orderBy(F.desc("signals"), F.desc("inbound"), "page_id")


def anchor_candidates(paragraphs: DataFrame, titles: DataFrame, least: int = 2, most: int = 5, cosine: float = 0.12) -> DataFrame:
    """``(para_id, title_id, phrase, score)``: targets ``(title_id, title, text)`` of at least that ``cosine`` to a paragraph
    ``(para_id, text)`` in which a run of ``least`` to ``most`` words (and 6 characters) of their title stands outside links;
    ``phrase`` is the longest such run."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9'’-]+"), F.lit(0))
    cut_once = lambda df, k, c: df.select(k, F.explode(F.array(words(c))).alias("_w"))  # noqa: E731  # a generator's column is computed once
    runs = F.explode(F.array_distinct(F.concat(*[ngrams(F.col("_w"), n) for n in range(least, most + 1)]))).alias("phrase")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\[[^\]]*\]\([^)]*\)", " \u0001 ")
    cut = paragraphs.select("para_id", F.explode(F.split(plain, "[^A-Za-z0-9'’ -]+")).alias("part"))  # a run stands between marks
    a = cut_once(cut, "para_id", F.col("part")).select("para_id", runs).distinct()
    b = cut_once(titles, "title_id", F.coalesce("title", F.lit(""))).select("title_id", runs).filter(F.char_length("phrase") >= 6)
    met = first_by(a.join(b, "phrase"), ["para_id", "title_id"], -F.char_length("phrase"), F.col("phrase"))
    # the same filters as a join sets, so that Spark shuffles a side's terms once for both uses
    va, vb = (text_terms(df, "text", k).filter(F.col(k).isNotNull() & F.col("term").isNotNull()) for df, k in ((paragraphs, "para_id"), (titles, "title_id")))
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"n_{k}"))
    dots = met.join(va.withColumnRenamed("n", "wa"), "para_id").join(vb.withColumnRenamed("n", "wb"), ["title_id", "term"]).groupBy("para_id", "title_id", "phrase").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("n_para_id") * F.col("n_title_id")), 4)
    return dots.join(norm(va, "para_id"), "para_id").join(norm(vb, "title_id"), "title_id").withColumn("score", score).filter(F.col("score") >= cosine).select("para_id", "title_id", "phrase", "score")


def anchor_phrases(paragraphs: DataFrame, titles: DataFrame, max_links: int | None = None, **limits) -> DataFrame:
    """Links to set in the paragraphs of a page (of each ``page_id``, if there is that column), in their order: each takes its
    candidate of largest score that no earlier one took (the least title_id among equals), ``max_links`` at most.

    A paragraph's choice is final once no earlier open paragraph of its page has that target among its candidates.
    So each round settles the first open paragraph of every page and all others that wait for none.
    """
    by = [c for c in ("page_id",) if c in paragraphs.columns]
    found = anchor_candidates(paragraphs, titles, **limits)
    found = checkpointed(found.join(paragraphs.select("para_id", *by), "para_id") if by else found, "anchors")
    done = []
    while not found.isEmpty():
        first = found.groupBy(*by, "title_id").agg(F.min("para_id").alias("para_id"))
        best = first_by(found, ["para_id"], -F.col("score"), F.col("title_id"))
        settled = checkpointed(best.join(first, [*by, "title_id", "para_id"], "left_semi").select(*by, "para_id", "title_id", "phrase", "score"), "anchors")
        done.append(settled)
        open_ = found.join(settled.select("para_id"), "para_id", "left_anti").join(settled.select(*by, "title_id"), [*by, "title_id"], "left_anti")
        found = checkpointed(open_, "anchors")
    rows = reduce(lambda x, y: x.unionByName(y), done) if done else found.select(*by, "para_id", "title_id", "phrase", "score")
    if max_links is None:
        return rows
    order = Window.partitionBy(*by).orderBy("para_id")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_links).drop("_rn")


def topic_coverage(topics: DataFrame) -> DataFrame:
    return topics.groupBy("pillar").agg(F.count("*").alias("topics"), F.count_if(F.col("covered")).alias("covered")).withColumn("authority", F.round(1 - F.col("covered") / F.col("topics"), 4))


#: Weights of the signals of a topic's score, and of the penalty for overlap.
SCORE_WEIGHTS = {"competitor": 0.15, "geo": 0.20, "seo": 0.15, "cluster": 0.15, "authority": 0.15, "social": 0.10}


def topic_scores(topics: DataFrame, n: int = 50) -> DataFrame:
    """Weighted signals less the overlap penalty from 0.40 on; dropped from 0.60 on."""
    volume, difficulty = F.col("volume"), F.col("difficulty")
    seo = F.least(F.lit(1.0), F.log10(volume + 1) / 4) * F.when(difficulty.isNull(), 0.75).otherwise(1 - difficulty / 200)
    total = sum((F.col(k) if k != "seo" else F.col("seo")) * w for k, w in SCORE_WEIGHTS.items())
    over = F.col("overlap")
    rows = topics.withColumn("seo", seo).filter(over < 0.6).withColumn("score", F.round(total - F.when(over >= 0.4, 0.30 * over).otherwise(0.0), 4))
    return rows.orderBy(F.desc("score"), "slug").limit(n).select("slug", "score")


def social_volume(posts: DataFrame) -> DataFrame:
    reach = F.sum(F.col("score") + 2 * F.col("comments"))
    return posts.groupBy("keyword").agg(F.count("*").alias("posts"), F.round(F.least(F.lit(1.0), F.count("*") / 40 + F.least(reach, F.lit(5000)) / 10000), 4).alias("signal"))


def competitor_inventory(posts: DataFrame, n: int = 50) -> DataFrame:
    """Newest posts; the first four title terms are the keyword where none is given."""
    keyword = F.when(F.coalesce("keyword", F.lit("")) != "", F.col("keyword")).otherwise(F.array_join(F.slice(terms("title"), 1, 4), " "))
    return posts.select("slug", keyword.alias("keyword"), "published").orderBy(F.desc("published"), "slug").limit(n)


def attach_keyword_context(opps: DataFrame, keywords: DataFrame) -> DataFrame:
    return opps.join(keywords, "key", "left").orderBy(F.desc("headroom"), F.desc_nulls_last("volume"), "key")


def domain_intersection(ranked: DataFrame, a: str, b: str) -> DataFrame:
    """Keywords that both domains rank for, and those that only b does."""
    one, two = (ranked.filter(F.col("domain") == d).select("keyword").distinct() for d in (a, b))
    return one.join(two, "keyword", "left_semi").withColumn("kind", F.lit("both")).unionByName(two.join(one, "keyword", "left_anti").withColumn("kind", F.lit("gap")))


def rank_demand(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates with fresh evidence first, then by value, effort and id."""
    n = evidence.groupBy("id").agg(F.count("*").alias("evidence"))
    rows = candidates.join(n, "id", "left").na.fill(0, ["evidence"]).withColumn("ready", F.col("evidence") > 0)
    return rows.orderBy(F.desc("ready"), F.desc("value"), F.asc_nulls_last("effort"), "id")


def evidence_is_fresh(rows: DataFrame, today: Column, days: int = 90, kinds: tuple[str, ...] = ("search", "customer", "analytics")) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds) & (F.col("reference") != "") & F.datediff(today, "observed").between(0, days))
