"""The prefix trie of conversations, rolled up by bands of depth.

A node is a distinct sequence of first turns; its key is two 64-bit lanes, each the exclusive or of its
turns' hashes with their places, so keys of all prefixes come from running windows over runs of at most
4096 turns and the sums of the runs before, however long a conversation is. Texts go no further than
their digests.

Roll-up: bands are ``HEIGHT`` levels high. A node sends its values to its band's root; the roots form a
trie of their own, a band lower, which is rolled up in the same way. Then the finished totals of the roots
go back: each node explodes to its ancestors inside its own band, each root to those of the band above. So
a row makes at most HEIGHT + 1 rows, and a trie of depth D takes log D to the base HEIGHT rounds.

Cases: turns are ordered by ``turn`` (null first), then by the first 64 characters of role and text and
their digest, so equal turns give one result; null role and text are empty; rows without conv_id belong to no
conversation; equal rows are turns of their own; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, stored, with_group

HEIGHT = 8
#: Turns of one conversation in one window, a multiple of HEIGHT.
RUN = 4096
#: Bytes of ids that travel as one row.
CHUNK = 1 << 16

# ---------------------------------------------------------------- turns and conversations


def _div(c: str | Column, n: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / n)


def conversation_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns(conv_id, d, s1, s2, words)``, d from 1, of ``conversations(conv_id, turn, role, text)``, and ``convs(conv_id, len)``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda at: F.conv(F.substring("_digest", at, 16), 16, -10).cast("bigint")
    rows = (
        conversations.filter(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", F.substring(role, 1, 64).alias("_role"), F.substring(text, 1, 64).alias("_text"), digest.alias("_digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
        .select("conv_id", "turn", "_role", "_text", lane(1).alias("s1"), lane(17).alias("s2"), "words")
    )
    placed = stored(numbered(rows, "conv_id", ["turn", "_role", "_text", "s1", "s2"], "turns", drop=["turn", "_role", "_text"]), "placed")
    turns = placed.select("conv_id", (F.col("_pos") + 1).alias("d"), "s1", "s2", "words")
    return turns, placed.filter("_pos = 0").select("conv_id", F.col("_n").alias("len"))


def rebuilt(turns: DataFrame, convs: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first h turns replaced by those of the first of its family of ``family`` ids.

    h is the crc32 of the decimal id modulo ``heads``; the family's first may have fewer turns or be absent.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % family
    planned = convs.select("conv_id", "len", h.alias("h"), base.alias("base"))
    firsts = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    taken = F.least("h", F.coalesce("base_len", F.lit(0)))
    plan = stored(planned.join(firsts, "base", "left").select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len")), "plan")
    own = with_group(turns, plan, "conv_id").filter(F.col("d") > F.col("h")).withColumn("d", F.col("d") - F.col("h") + F.col("k"))
    graft = turns.filter((F.col("conv_id") % family == 0) & (F.col("d") < heads)).withColumnRenamed("conv_id", "base")
    graft = graft.join(plan.select("conv_id", "base", "k", "len"), "base").filter(F.col("d") <= F.col("k"))
    columns = ["conv_id", "d", "s1", "s2", "words"]
    return own.select(columns).unionByName(graft.select(columns)), plan.select("conv_id", "len")


# ---------------------------------------------------------------- keys of prefixes


def prefix_keys(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, d, last, words, a, b)``: the key of the first d turns; ``last`` where the conversation ends there."""
    hashed = with_group(turns, convs, "conv_id").select(
        "conv_id", "d", (F.col("d") == F.col("len")).alias("last"), "words", _div(F.col("d") - 1, RUN).alias("run"),
        F.xxhash64("d", "s1", "s2").alias("a"), F.xxhash64(F.lit(7), "d", "s2", "s1").alias("b"), (F.col("len") > RUN).alias("long"),
    )
    hashed = stored(hashed, "hashed")
    runs = hashed.filter("long").groupBy("conv_id", "run").agg(F.bit_xor("a").alias("ra"), F.bit_xor("b").alias("rb"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("conv_id", "run", F.bit_xor("ra").over(before).alias("ca"), F.bit_xor("rb").over(before).alias("cb"))
    so_far = Window.partitionBy("conv_id", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.withColumns({c: F.bit_xor(c).over(so_far) for c in ("a", "b")})
    whole = lambda c: F.col(c).bitwiseXOR(F.coalesce(f"c{c}", F.lit(0))).alias(c)
    return own.join(carried, ["conv_id", "run"], "left").select("conv_id", "d", "last", "words", whole("a"), whole("b"))


def with_paths(keys: DataFrame, unit: int) -> DataFrame:
    """The rows whose depth is a multiple of ``unit``, with ``k``, their depth in units, and ``path``: the keys of their
    ancestors at such depths, from the root of their band (of the band above, for a root) down to the parent."""
    rows = keys.filter(F.col("d") % unit == 0).withColumn("k", _div("d", unit))
    rows = rows.withColumn("run", _div(F.col("k") - 1, RUN))
    ends = rows.filter(F.col("k") % RUN == 0).withColumn("run", F.col("run") + 1)  # a run's last turn starts the next one
    near = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(-HEIGHT, -1)
    root = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    seen = rows.withColumn("_ghost", F.lit(False)).unionByName(ends.withColumn("_ghost", F.lit(True))).withColumn("_seen", F.collect_list(F.struct("a", "b")).over(near))
    n = (F.col("k") - _div(F.col("k") - 1, HEIGHT) * HEIGHT).cast("int")
    path = F.slice(F.when(F.col("run") == 0, F.concat(root, F.col("_seen"))).otherwise(F.col("_seen")), -n, n)
    return seen.withColumn("path", path).filter("not _ghost").drop("_ghost", "_seen", "run")


# ---------------------------------------------------------------- roll-up


def totals(nodes: DataFrame, keys: DataFrame, depth: int, unit: int = 1) -> DataFrame:
    """``(a, b, leaves, saved, children)`` over the subtree of each of ``nodes(a, b, k, path, leaves, saved)``;
    children are counted in units."""
    top = F.col("k") % HEIGHT == 0
    home = F.when(top, F.struct("a", "b")).otherwise(F.element_at("path", 1)).alias("home")
    bands = nodes.select(home, "leaves", "saved").groupBy("home").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select("home.*", "leaves", "saved")
    if depth >= HEIGHT * unit:
        paths = with_paths(keys, unit * HEIGHT).groupBy("a", "b").agg(F.max("k").alias("k"), F.first("path").alias("path"))
        none = F.array().cast("array<struct<a:bigint,b:bigint>>")
        roots = bands.join(paths, ["a", "b"], "left").select("a", "b", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("path", none).alias("path"), "leaves", "saved")
        done = totals(stored(roots, "bands"), keys, depth, unit * HEIGHT).drop("children")
    else:  # one band: its root is the trie's
        done = bands
    own = nodes.filter(~top).select("a", "b", "path", "leaves", "saved")
    sent = own.unionByName(nodes.filter(top).select("a", "b", "path").join(done, ["a", "b"]))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def message(to: Column, i: Column) -> Column:
        home, parent = i == 0, i == F.size("path") - 1  # the band's root has its total, it only counts children
        return F.struct(to["a"].alias("a"), to["b"].alias("b"), F.when(home, zero).otherwise(F.col("leaves")).alias("leaves"), F.when(home, zero).otherwise(F.col("saved")).alias("saved"), F.when(parent, one).otherwise(zero).alias("children"))

    self = F.array(F.struct("a", "b", "leaves", "saved", zero.alias("children")))
    got = sent.select(F.explode(F.concat(F.transform("path", message), self)).alias("m")).select("m.*")
    return got.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])


# ---------------------------------------------------------------- ids of a node in one digest


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray | list]]:
    """``(a, b, values of the third column)`` for the runs of equal (a, b) of sorted batches; a run may come in parts."""
    for batch in batches:
        a, b, values = (batch.column(i) for i in range(3))
        a, b = a.to_numpy(), b.to_numpy()
        cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(a)]):
            if j > i:
                yield int(a[i]), int(b[i]), values.slice(i, j - i)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as texts of about CHUNK bytes, each with its first id."""
    rows: list[tuple] = []
    key, first, held, size = None, 0, [], 0

    def close() -> None:
        if held:
            rows.append((*key, first, ",".join(held)))

    for a, b, values in _runs(batches):
        for at in range(0, len(values), CHUNK // 8):
            ids = values.slice(at, CHUNK // 8).to_pylist()
            if key != (a, b) or size >= CHUNK:
                close()
                key, first, held, size = (a, b), ids[0], [], 0
            held.append(",".join(map(str, ids)))
            size += len(held[-1])
        if len(rows) >= 4096:
            yield pa.record_batch(list(zip(*rows)), ["a", "b", "first", "ids"])
            rows = []
    close()
    if rows:
        yield pa.record_batch(list(zip(*rows)), ["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each node in order, joined by commas; only its state is held."""
    rows: list[tuple] = []
    key, state = None, hashlib.sha256()
    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if key == (a, b):
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        if len(rows) >= 4096:
            yield pa.record_batch(list(zip(*rows)), ["a", "b", "ends_sha256"])
            rows = []
    if key is not None:
        rows.append((*key, state.hexdigest()))
    if rows:
        yield pa.record_batch(list(zip(*rows)), ["a", "b", "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)``: of the ascending decimal ids of ``ends(a, b, conv_id)``, joined by commas.

    A digest of one text has to be made in order, so a node's ids are sorted and packed into texts by many tasks
    and only those go through the node's one task, as a stream.
    """
    ordered = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    packed = ordered.mapInArrow(_chunks, "a bigint, b bigint, first bigint, ids string")
    dealt = packed.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return dealt.mapInArrow(_digests, "a bigint, b bigint, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of ``turns(conv_id, d, s1, s2, words)`` of the conversations ``convs(conv_id, len)``, one row each:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keys = stored(prefix_keys(turns, convs), "keys")
    depth = keys.agg(F.max("d")).first()[0] or 0
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count_if("last").alias("n_ends")]
    inner = with_paths(keys, 1).groupBy("a", "b").agg(*members, F.max("k").alias("k"), F.max("words").alias("words"), F.first("path").alias("path"))
    zero = F.lit(0).cast("bigint")
    everyone = convs.select("conv_id", (F.col("len") == 0).alias("last")).agg(*members).filter("n_convs > 0")
    root = everyone.select(zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", "n_ends", zero.alias("k"), zero.alias("words"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("path"))
    nodes = stored(inner.unionByName(root), "nodes")
    valued = nodes.select("a", "b", "k", "path", (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    ends = keys.filter("last").select("a", "b", "conv_id").unionByName(convs.filter("len = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    parent = F.try_element_at("path", F.lit(-1))
    found = nodes.drop("path", "words", "n_ends").join(totals(valued, keys, depth), ["a", "b"]).join(id_digests(ends), ["a", "b"], "left")
    up = nodes.select("a", "b", parent["a"].alias("pa"), parent["b"].alias("pb"))
    parents = up.join(nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")), ["pa", "pb"]).select("a", "b", "parent_conv_id")
    return found.join(parents, ["a", "b"], "left").select(
        "conv_id", F.col("k").alias("depth"), "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
