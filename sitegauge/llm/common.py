"""What several operators share: scratch tables, blobs in files, word hashes, links to groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch_path

# ---------------------------------------------------------------- scratch tables


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share (tests: a folder of this machine)."""
    return scratch_path(spark, name)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files go as soon as the query that made them has ended: its result is in a table by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as a scratch table and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and its path object (driver side, for listing and renaming)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


# ---------------------------------------------------------------- files of bytes


def name_parts(spark: SparkSession, path: str, suffix: str) -> None:
    """Give the files that Spark wrote into ``path`` their suffix; the name is the part's number."""
    fs, at = filesystem(spark, path)
    for status in fs.listStatus(at):
        file = status.getPath()
        name = file.getName()
        if name.startswith("part-"):
            target = spark._jvm.org.apache.hadoop.fs.Path(at, name.split("-c0")[0].split(".")[0] + suffix)
            if not fs.rename(file, target):
                raise OSError(f"cannot rename {file} to {target}")


def write_blobs(df: DataFrame, path: str, separator: str, suffix: str) -> None:
    """Write the one binary column of ``df``, a file per partition, each value followed by ``separator``.

    Spark's text writer passes bytes through as they are, so the files get its commit protocol and
    go to any Hadoop file system. The file formats here allow for the separator.
    """
    with tidy(df.sparkSession):
        df.select(F.col(df.columns[0]).cast("string").alias("value")).write.option("lineSep", separator).text(path)
    name_parts(df.sparkSession, path, suffix)


def read_blobs(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(path, content)`` of each file below ``path`` with the suffix."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
        .select("path", "content")
    )


# ---------------------------------------------------------------- words of many texts

#: ASCII letters and digits and all bytes of longer UTF-8 sequences belong to words.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at once.
_WINDOW = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix; ``x`` is uint64 and is not changed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            steps = np.full(_WINDOW + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def slices(strings: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``limit`` bytes (a longer text alone), with their first index."""
    if not len(strings):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(strings), 0), np.int64)
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(strings)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, strings.slice(a, b - a)


def word_hashes(strings: pa.Array, prefixes: tuple[int, ...] = (), window: int = _WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and where each text's words begin.

    Null is the empty text. A word is a run of ASCII letters, digits and bytes above 127.
    The second array has one entry more than there are texts. With ``prefixes`` (of at most 8) the first
    has a column for the words and one for their beginnings of each given number of bytes. Bytes are
    hashed by the window; a word that goes on in the next one gets the sum of its parts.
    """
    lower = pc.utf8_lower(pc.fill_null(strings, "").cast(pa.large_string()))
    n = len(lower)
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in (0, *prefixes)]
    data = np.frombuffer(lower.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    up, down = _power()
    where, total, at, open_ = np.zeros(n + 1, np.int64), 0, 0, 0  # open_: bytes so far of the word at the window's edge
    while at < len(data):
        to = min(at + window, len(data))
        if to < len(data):  # no cut in the first bytes of a word
            gaps = np.flatnonzero(~_WORD[data[to - 8 : to]])
            start = int(offsets[np.searchsorted(offsets, to) - 1])
            to = max([to] if not len(gaps) and start <= to - 8 else [x for x in (start, to - 7 + int(gaps[-1]) if len(gaps) else 0) if x > to - 8])
        inside = _WORD[data[at:to]]
        lo, hi = np.searchsorted(offsets, (at, to))
        own = offsets[lo:hi] - at
        left, right = np.zeros_like(inside), np.zeros_like(inside)
        left[1:], right[:-1] = inside[:-1], inside[1:]
        left[own] = False
        right[own[own > 0] - 1] = False
        begin, end = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=sums[1:])
        found = [(sums[e] - sums[begin]) * down[begin] for e in (end, *(np.minimum(end, begin + k) for k in prefixes))]
        so_far = 0
        if open_ and len(begin) and begin[0] == 0 and not (len(own) and own[0] == 0):
            columns[0][-1][-1:] += found[0][:1] * np.uint64(pow(_BASE, open_, 1 << 64))
            so_far, found = open_, [x[1:] for x in found]
        open_ = so_far * (len(begin) == 1) + to - at - int(begin[-1]) if len(begin) and end[-1] == to - at else 0
        begin = begin[1:] if so_far else begin
        where[lo:hi] = total + np.searchsorted(begin, own)
        total += len(begin)
        if len(begin):
            for column, x in zip(columns, found):
                column.append(x)
        at = to
    where[np.searchsorted(offsets, len(data)) :] = total
    hashes = [mix(np.concatenate(c) + np.uint64(k)) for c, k in zip(columns, (0, *prefixes))]
    return (np.stack(hashes, 1) if prefixes else hashes[0]), where


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; a shorter text is one run."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return mix(out + np.uint64(size))


# ---------------------------------------------------------------- rows of any columns


def whole_row(df: DataFrame):
    """All columns as one struct ``row``: helper columns beside it can't clash with them; ``row.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


# ---------------------------------------------------------------- joins that Spark can split


def apart(column: str, kind: str = "bigint"):
    """The same key in another form, so that a join on it is not planned upon an earlier aggregate's
    partitioning: both sides get their own exchange, whose hot partitions Spark then splits."""
    if kind == "string":
        return F.concat(F.lit("="), F.col(column))
    return F.col(column).bitwiseXOR(F.lit(0x5DEECE66D))


def with_group(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to the aggregate ``groups`` of the same key; a key may hold any share of the rows."""
    kind = dict(groups.dtypes)[key]
    return (
        rows.withColumn("_apart", apart(key, kind))
        .join(groups.withColumn("_apart", apart(key, kind)).drop(key), "_apart", how).drop("_apart")
    )


# ---------------------------------------------------------------- places in sorted groups


def numbered(rows: DataFrame, group: str, order: list[str], name: str, drop: list[str] = ()) -> DataFrame:
    """``rows`` with ``_pos``, the place (from 0) in its group by ``order``, and ``_n``, the group's rows.

    Sorted over all tasks by range and written, so a group may hold any share of the rows; a row's number
    then comes from its task's first number. ``group`` is never null. Rows equal in all keys are told
    apart by where they were read, so many equal rows don't meet in one task either. Columns of ``drop`` go
    once the rows are sorted.
    """
    keys = [group, *order]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt", *drop)
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), name)  # task << 33 | row of the task
    task = F.shiftright("_at", 33)
    sizes = kept.groupBy(task.alias("_task")).agg(F.count("*").alias("_size"))
    before = sizes.select("_task", (F.sum("_size").over(Window.orderBy("_task")) - F.col("_size")).alias("_before"))
    # one row for each task of the sort: its size doesn't depend on the data
    at = kept.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn("_row", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    groups = at.groupBy(group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    placed = with_group(at, groups, group).withColumn("_pos", F.col("_row") - F.col("_first"))
    return placed.drop("_at", "_task", "_before", "_row", "_first")


# ---------------------------------------------------------------- connected groups


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for all nodes of the undirected ``edges(a, b)``; root is the smallest node.

    Alternates large-star and small-star steps. Each round is written to the shared scratch folder
    and the earlier one dropped; only counts and sums come to the driver.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            rows = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        else:
            rows = e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        least = rows.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        joined = with_group(rows, least, "a")
        if large:
            out = joined.filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(a != b).distinct()

    clean = edges.select("a", "b").filter(a.isNotNull() & b.isNotNull() & (a != b))
    path, seen = scratch(spark, "links"), None
    clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().write.parquet(path)
    for _ in range(max_rounds):
        e = spark.read.schema("a bigint, b bigint").parquet(path)
        nxt = scratch(spark, "links")
        step(step(e, True), False).write.parquet(nxt)
        drop(spark, path)
        path = nxt
        e = spark.read.schema("a bigint, b bigint").parquet(path)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    star = e.select(a.alias("node"), b.alias("root"))
    return star.unionByName(e.select(b.alias("node"), b.alias("root")).distinct())
