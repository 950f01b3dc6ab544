"""Text facts as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that metadata, links and topics are compared without.
METADATA_STOP_WORDS = """
a an and are as at be by for from has how in into is it of on or our than that the their this to up vs was were will with
your you we i us
""".split()
LINK_STOP_WORDS = """
a an and are as at be by for from has have how in into is it its of on or our than that the their this to up vs was were
will with your you we i us about all also can more not one out so if no do does get new use used using
""".split()
TOPIC_STOP_WORDS = """
a an and are as at be by for from has have how in into is it its of on or our than that the their this to up vs was were
will with your you we i us about all also can more not one out so if no do does get new use used using what why when
which who should
""".split()
#: Profile -> pattern of a token, stop words.
PROFILES = {
    "topic": (r"[a-z0-9]+(?:'[a-z]+)?", TOPIC_STOP_WORDS),
    "link": (r"[a-z0-9]+(?:'[a-z]+)?", LINK_STOP_WORDS),
    "metadata": (r"[a-z0-9]+", METADATA_STOP_WORDS),
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def terms(col, profile: str = "topic", least: int = 3) -> Column:
    """Lower-cased tokens of at least ``least`` letters that are no stop words of the profile, in order, repeats kept."""
    pattern, stop = PROFILES[profile]
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: (F.char_length(w) >= least) & ~w.isin(stop))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def wilson(hits: Column, trials: Column, z: float = 1.96) -> Column:
    """``(rate, low, high)`` of a share with its 95 % interval, 4 decimals; (0, 0, 1) without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    low, high = (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)
    r = lambda c: F.round(c, 4)
    return F.struct(
        F.coalesce(r(p), F.lit(0.0)).alias("rate"), F.coalesce(r(F.greatest(F.lit(0.0), low)), F.lit(0.0)).alias("low"), F.coalesce(r(F.least(F.lit(1.0), high)), F.lit(1.0)).alias("high")
    )


def plain_words(col) -> Column:
    """Words of Markdown text without link targets and markup."""
    text = F.regexp_replace(_c(col), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_extract_all(F.regexp_replace(text, r"[#*_`>|]", " "), F.lit(r"\S+"), F.lit(0))


def links(col) -> Column:
    """Markdown links as ``(label, url)``, images left out."""
    found = F.regexp_extract_all(F.regexp_replace(_c(col), r"!\[[^\]]*\]\([^)]*\)", ""), F.lit(r"\[[^\]]*\]\([^)\s]+\)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(m, r"\(([^)\s]+)\)$", 1).alias("url")))


def headings(col, level: int = 2) -> Column:
    found = F.regexp_extract_all(_c(col), F.lit(rf"(?m)^#{{{level}}} +\S.*$"), F.lit(0))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, "^#+ +", "")))


def numbers(col) -> Column:
    """Numbers as written in prose without separators and currency, percent kept, single digits left out."""
    found = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?%?"), F.lit(0))
    clean = F.transform(found, lambda n: F.regexp_replace(n, ",", ""))
    return F.filter(clean, lambda n: F.char_length(n) > 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space."""
    last = F.size(tokens) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
