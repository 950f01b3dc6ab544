"""The ``site`` key: operators work on many sites at once where their inputs have that column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keys(*frames: DataFrame) -> list[str]:
    """``["site"]`` if all of the inputs have that column, else none: then all rows are of one site."""
    return ["site"] if all("site" in f.columns for f in frames) else []


def page_keys(*frames: DataFrame) -> list[str]:
    """``["page_id"]`` if all of the inputs have that column: pages are then told apart by it, not by their address alone."""
    return ["page_id"] if all("page_id" in f.columns for f in frames) else []
