"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles, each labelled with how often it occurred before.
For each of ``n_sketches`` hash functions the ``2`` labelled shingles of least hash are taken *in the
order of the text* and make a sketch, so that texts with the same shingles in another order differ.
Documents that share a sketch are compared: the aligned shingles ``m`` (longest common subsequence,
searched within the band that the threshold leaves) must reach ``m / (n1 + n2 - m) >= threshold``.

Two documents of similarity s share a sketch with a chance near s*s, so that of 16 sketches none is
shared at s = 0.8 in 1 of 12 million cases. Buckets are compared in two steps. First every document
meets the bucket's least document; that joins most groups, in linear work. Then all pairs of a bucket
whose documents are not in one group yet meet in cells of bounded size, with their shingles: what the
counts of shingles or their histograms rule out (both are upper bounds of the aligned shingles) is
left out, all others are verified, but for those that links found in the same task have joined meanwhile.

Cases: null texts are in no group; texts that are equal byte for byte share a class, empty ones too;
texts without any word are only grouped with equal ones; fewer than five words make one shingle.
Rows with the same id count as one document, which takes the least class. Rows with a null id are left out. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, shingles, slices, stored, whole_row, with_group, word_hashes

SHINGLE, SKETCHES, THRESHOLD = 5, 16, 0.8
BINS, CELL = 512, 1024
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the occurrence: the first of a shingle differs from the second."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(len(s), bool)
    new[0], new[1:] = True, s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix(h + nth * np.uint64(0xD1B54A32D192ED03)), h)


def sketch(h: np.ndarray, n_sketches: int = SKETCHES, run: int = 1 << 15) -> np.ndarray:
    """Order MinHash of one text's labelled shingles, in runs of bounded size."""
    most = np.uint64(2**64 - 1)
    rows = np.arange(n_sketches)
    least, place = np.full((2, n_sketches), most), np.zeros((2, n_sketches), np.int64)
    for start in range(0, len(h), run):
        ranks = h[None, start : start + run] * _SEEDS[:n_sketches, None]
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> np.uint64(29)
        for _ in range(min(2, ranks.shape[1])):  # the two least of this run against the two so far
            at = ranks.argmin(1)
            value, at = ranks[rows, at], at + start
            ranks[rows, at - start] = most
            first, second = value < least[0], value < least[1]
            least[1], place[1] = np.where(first, least[0], np.where(second, value, least[1])), np.where(first, place[0], np.where(second, at, place[1]))
            least[0], place[0] = np.where(first, value, least[0]), np.where(first, at, place[0])
    if len(h) == 1:
        place[1] = place[0]
    early, late = place.min(0), place.max(0)
    return mix(h[early] * np.uint64(3) + mix(h[late]) + _SEEDS[:n_sketches])


def histogram(h: np.ndarray) -> bytes:
    """Counts of labelled shingles by ``BINS`` bins; the sum of two texts' lesser counts is at least what they share.

    Where a count is over 255 all are set to 255, which rules nothing out.
    """
    counts = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=BINS)
    return (counts if counts.max() < 256 else np.full(BINS, 255)).astype(np.uint8).tobytes()


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the longest common subsequence m of a and b has m / (len(a) + len(b) - m) >= least."""
    n, m = len(a), len(b)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))  # least number of aligned shingles
    if not n or not m or min(n, m) < need:
        return False
    if n == m and np.count_nonzero(a == b) >= need:
        return True
    k = min(n, m)  # equal ends take part in some longest alignment
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(differ[0]) if len(differ) else k - head
    need -= head + tail
    if need <= 0:
        return True
    a, b = a[head : n - tail], b[head : m - tail]
    shared, pa_, pb = np.intersect1d(a, b, return_indices=True)  # labels make shingles unique
    if len(shared) < need:
        return False
    pb = pb[np.argsort(pa_)]
    if (np.diff(pb) > 0).all():
        return True
    # Longest increasing run of partners = longest common subsequence, kept within the band.
    shift = np.sort(pa_) - pb
    band = len(a) + len(b) - 2 * need
    pb = pb[np.abs(shift) <= band]
    tails: list[int] = []
    for x in pb.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) >= need


def _sketches(batches: Iterator[pa.RecordBatch], n_sketches: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.string()), ("sketches", pa.list_(pa.int64()))])
    for batch in batches:
        text = batch.column("text")
        for at, part in slices(text):
            words, where = word_hashes(part)
            lists = []
            for i in range(len(part)):
                w = words[where[i] : where[i + 1]]
                lists.append(sketch(labelled(shingles(w, SHINGLE)), n_sketches).view(np.int64) if len(w) else None)
            ids = batch.column("doc_id").slice(at, len(part))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("copy").slice(at, len(part)), pa.array(lists, pa.list_(pa.int64()))], schema=schema
            )


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        one = np.asarray(pc.fill_null(pc.binary_length(batch.column("text_a")), 0), np.int64)
        two = np.asarray(pc.fill_null(pc.binary_length(batch.column("text_b")), 0), np.int64)
        run = (np.cumsum(one + two) - one - two) >> 20
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            wa, oa = word_hashes(batch.column("text_a").slice(lo, hi - lo))
            wb, ob = word_hashes(batch.column("text_b").slice(lo, hi - lo))
            for i in range(hi - lo):
                x, y = wa[oa[i] : oa[i + 1]], wb[ob[i] : ob[i + 1]]
                if len(x) and len(y):
                    keep[lo + i] = aligned(labelled(shingles(x, SHINGLE)), labelled(shingles(y, SHINGLE)), least)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``(a, b)`` of ``nodes(node, sketches)``, one for each sketch of a node at most, and
    ``(node, k1)`` of each sketch that several nodes have."""
    rows = nodes.select("node", F.explode(F.array_distinct("sketches")).alias("k1"))
    least = rows.groupBy("k1").agg(F.min("node").alias("b"), F.max("node").alias("_last")).filter("b < _last").drop("_last")
    shared = stored(with_group(rows, least, "k1"), "buckets")
    return shared.filter("node > b").select(F.col("node").alias("a"), "b").distinct(), shared.select("node", "k1")


def cells(shared: DataFrame, roots: DataFrame, cell: int = CELL) -> DataFrame:
    """``(node, root, cell, side)`` such that any two nodes of a bucket ``(node, k1)`` with other roots meet in a cell.

    The rows of a bucket's most frequent root never meet each other, so that a group which is joined
    already costs work in proportion to its size. Rows are cut into blocks of about ``cell``; each two
    blocks of the others make a cell, and so do each block of the others and each of the frequent root. Of buckets with the same nodes one is enough.
    Pairs count in a cell if their sides differ or are -1.
    """
    rows = stored(shared.join(roots, "node", "left").select("node", "k1", F.coalesce("root", "node").alias("root")), "rooted")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in (0, 1)]
    sizes = rows.groupBy("k1", "root").agg(F.count("*").alias("n"), *marks).groupBy("k1").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("many"), F.sum("n").alias("all"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)])
    blocks = lambda n: F.ceil(F.col(n) / cell).cast("int").alias(n)
    mixed = sizes.withColumn("few", F.col("all") - F.col("many")).filter("few > 0")
    once = mixed.groupBy("mark0", "mark1", "all").agg(F.min("k1").alias("k1"), F.first("major").alias("major"), F.first("many").alias("many"), F.first("few").alias("few"))
    plan = once.select("k1", "major", blocks("many"), blocks("few"))
    met = with_group(rows, stored(plan, "cells"), "k1")
    own = F.col("root") == F.col("major")
    at = F.pmod(F.xxhash64("node"), F.when(own, F.col("many")).otherwise(F.col("few"))).cast("int")
    met = met.select("node", "root", "k1", own.alias("own"), at.alias("at"), "many", "few")
    i = F.col("at")
    made = lambda kind, x, y, side: F.struct(F.xxhash64("k1", F.lit(kind), x, y).alias("cell"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    others = F.concat(
        F.transform(each("few"), lambda j: made(0, F.least(i, j), F.greatest(i, j), F.when(i == j, -1).otherwise(i))), F.transform(each("many"), lambda j: made(1, i, j, F.lit(0)))
    )
    return met.select("node", "root", F.explode(F.when(F.col("own"), F.transform(each("few"), lambda j: made(1, j, i, F.lit(1)))).otherwise(others)).alias("c")).select("node", "root", "c.*")


def _cell_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b)`` between rows ``(cell, root, node, side, shingles)`` of a cell, in batches of rows sorted by cell
    and root; pairs that earlier links of the task have joined are not tried."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    parent: dict[int, int] = {}

    def top(g: int) -> int:
        while g in parent:
            g = parent[g]
        return g

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        node, root, side, cell = (table[c].to_numpy() for c in ("node", "root", "side", "cell"))
        h = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
        n = np.array([len(x) for x in h], np.int64)
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (root[1:] != root[:-1])])
        ends = np.append(np.flatnonzero(new)[1:], len(cell))
        after = ends[np.cumsum(new) - 1]  # rows of the same root come before that
        count = np.searchsorted(cell, cell, side="right") - after
        bins = np.stack([np.frombuffer(histogram(x), np.uint8) for x in h])
        done, at, links = np.cumsum(count), 0, []
        while at < len(cell):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + (1 << 16), side="right")))
            c = count[at:to]
            x = np.repeat(np.arange(at, to), c)
            y = np.repeat(after[at:to], c) + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
            need = np.ceil(least * (n[x] + n[y]) / (1 + least) - 1e-9)
            ok = (np.minimum(n[x], n[y]) >= need) & ((side[x] < 0) | (side[x] != side[y]))
            x, y, need = x[ok], y[ok], need[ok]
            for k in range(0, len(x), 2048):
                i, j = x[k : k + 2048], y[k : k + 2048]
                good = np.minimum(bins[i], bins[j]).sum(1, dtype=np.int64) >= need[k : k + 2048]
                for p, q in zip(i[good].tolist(), j[good].tolist()):
                    one, two = top(int(root[p])), top(int(root[q]))
                    if one != two and aligned(h[p], h[q], least):
                        parent[max(one, two)] = min(one, two)
                        links.append((max(node[p], node[q]), min(node[p], node[q])))
            at = to
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cell = batch.column("cell").to_numpy()
        if held and held[-1].column("cell")[-1].as_py() != cell[0]:
            yield from found(pa.Table.from_batches(held))
            held = []
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
        if cut:
            yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from found(pa.Table.from_batches(held))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in slices(batch.column("text")):
            words, where = word_hashes(part)
            made = [labelled(shingles(words[where[i] : where[i + 1]], SHINGLE)).tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(made, pa.binary())], ["node", "shingles"])


def other_links(base: DataFrame, shared: DataFrame, roots: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` that join groups of ``roots(node, root)``, enough to join all that share a sketch and are similar.
    The texts of nodes that meet others alone are shuffled, as shingles."""
    met = stored(cells(shared, roots, cell), "met")
    wanted = met.select(F.col("node").alias("doc_id")).distinct()
    texts = base.filter(maybe(wanted)("doc_id")).join(wanted, "doc_id", "left_semi").distinct()
    full = met.join(stored(texts.mapInArrow(_shingled, "node bigint, shingles binary"), "shingled"), "node")
    full = full.select("cell", "root", "node", "side", "shingles").repartition("cell").sortWithinPartitions("cell", "root")
    return full.mapInArrow(lambda it: _cell_links(it, threshold), "a bigint, b bigint").distinct()


def maybe(wanted: DataFrame, bits: int = 25):
    """A filter that holds for all ids of ``wanted(doc_id)`` and for few others, before an exact semi join.

    It is a bitmap of ``2**bits`` hash values, 4 MB however many ids there are, made by Spark.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = wanted.select(bit.alias("h")).selectExpr("shiftright(h, 6) as w", "shiftleft(1L, cast(h % 64 as int)) as b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[np.asarray(rows["w"])] = np.asarray(rows["b"])
    sent = wanted.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        at = np.asarray(h) % (1 << bits)
        return pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda column: hit(F.xxhash64(column))


def _verified(base: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose texts are similar; the texts of ``pairs`` alone are shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(base.filter(maybe(wanted)("doc_id")).join(wanted, "doc_id", "left_semi").distinct(), "texts")
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return stored(both.mapInArrow(lambda it: _verify(it, threshold), "a bigint, b bigint"), "verified")


def near_duplicates(docs: DataFrame, n_sketches: int = SKETCHES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id)`` of each document of ``docs(doc_id, text)``; class_id is the least id of its group.

    Copies byte for byte are folded first, so they make no pairs. Candidate pairs, verified links and
    groups stay in tables; the texts of candidates alone are shuffled, once for each side of a pair.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    marked = base.withColumn("copy", F.md5("text"))
    marks = stored(
        marked.mapInArrow(lambda it: _sketches(it, n_sketches), "doc_id bigint, copy string, sketches array<bigint>"), "sketches"
    )
    least = marks.filter("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("node"))
    member = with_group(marks.filter("copy is not null"), least, "copy").select("doc_id", "node", "sketches")
    member = member.unionByName(marks.filter("copy is null").select("doc_id", F.col("doc_id").alias("node"), F.lit(None).cast("array<bigint>").alias("sketches")))
    member = stored(member, "members")
    nodes = member.filter("doc_id = node and sketches is not null").select("node", "sketches")
    found, shared = links(nodes)
    true = _verified(base, stored(found, "pairs"), threshold)
    more = stored(other_links(base, shared, stored(components(true), "roots"), threshold), "apart")
    roots = stored(components(true.unionByName(more)), "roots")
    return (
        member.select("doc_id", "node").join(roots, "node", "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("class_id"))
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but the document of least id of each group. Rows with a null id stay."""
    away = near_duplicates(docs, **options).filter("class_id < doc_id")
    return docs.select(whole_row(docs), "doc_id").join(stored(away.select("doc_id"), "dropped"), "doc_id", "left_anti").select("row.*")
