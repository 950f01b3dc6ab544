"""Structured Streaming forms of the run-over-run state: hits, new events, history, streaks, regressions.

Late data beyond a watermark is dropped; lines without a time are counted apart, as windows would drop them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diff import find_baseline, snapshot_regressions
from ..operators.logs import bot_matches, parse_access_log
from ..operators.pages import first_by
from ..sources.tables import latest, upsert_history


def stream_crawler_hits(lines: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Bot hits per window of event time from a stream of log lines."""
    rows = bot_matches(parse_access_log(lines).filter("ts is not null").withWatermark("ts", late))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "bot").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("start"), "bot", "hits")


def stream_untimed_lines(lines: DataFrame) -> DataFrame:
    return parse_access_log(lines).filter("ts is null").groupBy().agg(F.count("*").alias("lines"))


def stream_new_events(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events whose key was not seen from their source within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "dedupe_key"])


def stream_last_keys(read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], keep: int = 500) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on ``(source, dedupe_key, ts)``: events whose key is not among the last ``keep`` of their source.

    ``read`` gives the keys so far as ``(source, dedupe_key, batch, place)``, ``write`` takes a batch's new events and
    the keys to keep. A key that comes back after ``keep`` others is new again. Keys are ranked within their
    source by a window with a limit, so a source of any size is cut down by many tasks first.
    """

    def pick(batch: DataFrame, number: int) -> None:
        last = read()
        new = first_by(batch, ["source", "dedupe_key"], F.col("ts")).join(last, ["source", "dedupe_key"], "left_anti")
        added = new.select("source", "dedupe_key", F.lit(number).cast("bigint").alias("batch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("place"))
        kept = latest(last.unionByName(added), ["source"], [F.desc("batch"), F.desc_nulls_last("place"), F.desc("dedupe_key")], keep)
        write(new, kept)

    return pick


def stream_history(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is merged into the history table."""

    def merge(batch: DataFrame, _: int) -> None:
        write(upsert_history(read(), batch, keys, values)[0])

    return merge


def stream_missing_streak(runs: DataFrame) -> DataFrame:
    """State per key of ``(key, run, present)``: ``streak`` grows while it is missing, 2 means lost, seen resets it."""

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(pdfs)).sort_values("run")
        for run, present in zip(rows["run"], rows["present"]):
            if run > last:
                streak, last = (0 if present else streak + 1), int(run)
        state.update((streak, last))
        yield pd.DataFrame({"key": [key[0]], "run": [last], "streak": [streak], "state": ["kept" if streak == 0 else "possibly_lost" if streak == 1 else "lost"]})

    return runs.groupBy("key").applyInPandasWithState(update, "key string, run bigint, streak bigint, state string", "streak bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def stream_page_regressions(pages: Callable[[], DataFrame], meta: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on the provenance table: each new complete snapshot against its as-of baseline, all pairs
    of a batch in one job. ``pages`` are those of all snapshots."""

    def compare(batch: DataFrame, _: int) -> None:
        pairs = find_baseline(meta()).filter("baseline is not null").join(batch.select("crawl_id").distinct(), "crawl_id", "left_semi")
        write(snapshot_regressions(pages(), pairs.select("crawl_id", "baseline")))

    return compare
