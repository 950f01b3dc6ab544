"""A manifest of a dataset as a tree of digests, with a proof for each row.

Rows of a group are leaves in a given order; every eight consecutive nodes (the last run may have fewer,
even one) become their digest while a group has more than one. What remains is the group's subroot. The
subroots, in order of their groups, likewise give the root. A digest is the lower-case hex SHA-256 of its
children's digests, joined as text.

The tree is built by time-forward processing. A node's time is its last leaf, then its level, so children
come before parents. Each node sends its digest to its parent through a priority queue ordered by the
receiver's time; in a block of 512 leaves that queue is a heap, and beyond a block it is Spark's sort: the
tops of all blocks are written as messages to the next round, where they are the leaves of new blocks, so
10^10 rows take four rounds. The reversed sweep starts at the root: each node hands its children what it
got itself, preceded by their siblings, until each leaf has its whole proof. No task holds more than one
block, however many rows a group has.

Cases: null, empty and repeated values are part of the leaf's text (``-`` for null); rows of equal order
are placed by their digest, equal ones are interchangeable; a null order comes first, the null group is
the first group; an empty table gives an empty result. Further columns come back unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, stored

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

# ---------------------------------------------------------------- digests as columns


def field(value: str | Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    value = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


# ---------------------------------------------------------------- sweeps of one block


def _levels(n: int) -> int:
    """Levels of a block whose group has n nodes: up to the block's top, or to the subroot if that comes first."""
    levels, width = 0, 1
    while levels < LEVELS and width < n:
        levels, width = levels + 1, width * FAN
    return levels


def forward(leaves: list[str], levels: int) -> list[tuple[int, int, list[str]]]:
    """All inner nodes of a block in order of time as ``(level, index, digests of the children)``; the last is the top."""
    queue: list[tuple[int, int, int, str]] = []  # time and level of the receiver, index of the sender, digest
    nodes, last = [], len(leaves) - 1

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            end = (index // FAN + 1) * FAN ** (level + 1) - 1
            heapq.heappush(queue, (min(end, last), level + 1, index, digest))

    for time, leaf in enumerate(leaves):
        send(0, time, leaf)
        while queue and queue[0][0] == time:
            level, children = queue[0][1], []
            while queue and queue[0][:2] == (time, level):
                _, _, index, digest = heapq.heappop(queue)
                children.append(digest)
            nodes.append((level, index // FAN, children))
            send(level, index // FAN, _digest(children))
    return nodes


def _digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def backward(nodes: list[tuple[int, int, list[str]]], n: int, suffix: list[dict]) -> list[list[dict]]:
    """The proofs of the block's n leaves, given that of its top: nodes take theirs in reversed order of time."""
    waiting = {(nodes[-1][0], nodes[-1][1]) if nodes else (0, 0): suffix}
    for level, index, children in reversed(nodes):
        own = waiting.pop((level, index))
        for slot in range(len(children)):
            beside = {"left": "".join(children[:slot]), "right": "".join(children[slot + 1 :])}
            waiting[level - 1, index * FAN + slot] = [beside, *own]
    return [waiting[0, i] for i in range(n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of rows sorted by ``(g, b)``; one may go over several batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column("g").to_pylist(), batch.column("b").to_pylist()))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], k, i
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- rounds of blocks


def _blocked(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", *more)


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """``leaves(g, i, n, digest)`` and, for each further round, the tops of the blocks before, until groups have one."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in _blocks(batches):
            digests, n = block.column("digest").to_pylist(), block.column("n")[0].as_py()
            nodes = forward(digests, _levels(n))
            out.append((block.column("g")[0].as_py(), block.column("b")[0].as_py(), -(-n // BLOCK), _digest(nodes[-1][2]) if nodes else digests[0]))
            if len(out) >= 4096:
                yield _record(out)
                out = []
        if out:
            yield _record(out)

    def _record(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["g", "i", "n", "digest"])

    tables = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        messages = tables[-1].select("g", F.expr(f"i div {BLOCK}").alias("b"), "i", "n", "digest")
        tables.append(stored(_blocked(messages, "i").mapInArrow(tops, "g string, i bigint, n bigint, digest string"), "tops"))
        most = -(-most // BLOCK) if most > BLOCK else 1
    return tables


def proofs(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the first table ``(g, i, n, digest, row)`` with ``path``, ``subroot`` and ``root``;
    ``top(g, path, subroot, root)`` is what the last node of each group got."""
    if len(tables) == 1:  # every group has one node
        return tables[0].join(top, "g")
    got = top.withColumn("i", F.lit(0).cast("bigint"))
    for table in reversed(tables[:-1]):
        kind = table.schema["row"].dataType if "row" in table.columns else T.StructType().add("none", "string")
        empty = {"i": "bigint", "n": "bigint", "digest": "string", "row": kind, "path": PATH, "subroot": "string", "root": "string"}
        null = lambda c: F.lit(None).cast(empty[c]).alias(c)
        nodes = table.select("g", F.expr(f"i div {BLOCK}").alias("b"), *[c if c in table.columns else null(c) for c in empty])
        given = got.select("g", F.col("i").alias("b"), *[c if c in ("path", "subroot", "root") else null(c) for c in empty])
        schema = T.StructType([f for f in nodes.schema if f.name not in ("b", "n")])
        got = _blocked(nodes.unionByName(given), "i").mapInArrow(_deliver, schema)
    return got


def _deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each block the first row is the message to its top (null ``i`` sorts first), then come its nodes."""
    for block in _blocks(batches):
        suffix, subroot, root = (block.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        block = block.slice(1).combine_chunks()
        if not len(block):
            continue
        digests, n = block.column("digest").to_pylist(), block.column("n")[0].as_py()
        paths = backward(forward(digests, _levels(n)), len(digests), suffix)
        whole = block.select(["g", "i", "digest", "row"]).append_column("path", pa.array(paths, _PATH))
        for name, value in (("subroot", subroot), ("root", root)):
            whole = whole.append_column(name, pa.array([value] * len(digests), pa.string()))
        yield from whole.to_batches()


def manifest(rows: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """All columns of ``rows`` with ``subroot``, ``root`` and ``path``, the siblings ``(left, right)`` level by level.

    ``digest`` is the column of the leaves; ``rows`` has none of the three new columns.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # sorts as the group, null first
    keyed = rows.select(name.alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    leaves = stored(_placed(numbered(keyed, "g", ["o", "digest"], "leaves"), "row"), "placed")
    inner = rounds(leaves)
    subroots = inner[-1].select(F.lit("").alias("g"), F.struct(F.col("g").alias("name"), "digest").alias("row"), F.col("g").alias("o"), "digest")
    outer = rounds(stored(_placed(numbered(subroots, "g", ["o"], "subroots"), "row"), "groups"))
    root = outer[-1].select("g", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = proofs(outer, root).select(F.col("row.name").alias("g"), "path", F.col("row.digest").alias("subroot"), "root")
    return proofs(inner, stored(tops, "proofs")).select("row.*", "subroot", "root", "path")


def _placed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("g", F.col("_pos").alias("i"), F.col("_n").alias("n"), "digest", *more)


def document_manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, tampered_leaf, subroot, root, path)`` of ``docs``, a group for each ``lang``.

    ``tampered_leaf`` is the leaf of the text with A-Z in lower case where 3 divides the crc32 of the decimal
    doc_id (never that of a null one), else null.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    facts = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        "lang", "doc_id", leaf_digest(*facts, field("text")).alias("leaf"), F.when(tampered, leaf_digest(*facts, field(F.translate("text", upper, lower)))).alias("tampered_leaf")
    )
    return manifest(stored(leaves, "digests"), "lang", "doc_id", "leaf").drop("lang")  # the sort samples its input: texts are read once


def verified(proved: DataFrame) -> DataFrame:
    """Digests of each row's proof and whether the leaf, tampered with or not, still leads to the root."""
    root = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return (
        proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
