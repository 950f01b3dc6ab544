"""Predicates on page records, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directives() -> Column:
    return F.lower(F.concat(F.coalesce("meta_robots", F.lit("")), F.lit(","), F.coalesce("x_robots_tag", F.lit(""))))


def is_noindex() -> Column:
    """``noindex`` anywhere, or a comma token that is exactly ``none``; tokens are not trimmed."""
    return F.contains(directives(), F.lit("noindex")) | F.array_contains(F.split(directives(), ","), "none")


def is_nofollow() -> Column:
    return F.contains(directives(), F.lit("nofollow")) | F.array_contains(F.split(directives(), ","), "none")


def is_html() -> Column:
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml+xml"))


def fetched() -> Column:
    return F.coalesce(F.col("error_type"), F.lit("")) == ""


def is_indexable() -> Column:
    return fetched() & F.coalesce(F.col("status") == 200, F.lit(False)) & is_html() & ~is_noindex()


SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(col: str = "severity") -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(col)), F.lit(0)).cast("int").alias("rank")


def findings(rows, *rules: tuple[Column, str, str, Column], keep: tuple[str, ...] = ("url",)):
    """One row per rule that holds for a row: ``(keep.., type, severity, detail)``. One pass, no union."""
    made = [F.when(cond, F.struct(F.lit(kind).alias("type"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity"), detail.cast("string").alias("detail"))) for cond, kind, sev, detail in rules]
    return rows.select(*keep, F.explode(F.filter(F.array(*made), lambda f: f.isNotNull())).alias("f")).select(*keep, "f.*")
