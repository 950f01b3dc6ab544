"""Fuzzy line dedup with DataFrame functions only.

Lines are normalised (words of letters and digits, in lower case). Equal ones
are folded first. Each distinct line gets a 60-bit SimHash in six blocks of ten bits: its distinct words are
dealt to the blocks by hash, a block counts for each of its bits the words that have it, and a bit is set where more than
half do. One changed word thus touches two blocks at most, two touch four, and the pigeonhole principle leaves
two that agree, in their counts as well as in their bits. Lines are joined on sets of equal blocks: one of the six where
a line has over 22 words, two for shorter ones, three for those of under eight; lines of 8 to 12 and of 18 to 22 words go
by both kinds, so a word more or less parts no pair. A block goes by 32 bits of its words' hash. Sets that hold fewer
than two words (three for longer lines) tell too little and are left out. In lines of over 64 words only words of certain
hashes count, the same in near lines; twice as few from 128 words on, and again at each doubling, where two near lines on
either side of such a length are not found.

Candidates differ in at most ``BITS`` bits of the fingerprint (lines of at most ``SHORT`` characters in any
number: a word is a large part of theirs); two lines are linked if their edit
similarity, 1 - levenshtein / longer length, is at least ``similarity``: in characters, for lines of over
64 words in words. Candidates are taken in two
steps. First each line meets the least line of its buckets; that joins most groups, in linear work.
Then, in buckets whose lines are not in one group yet, all pairs of other groups meet, but for the lines
of a bucket's most frequent group among themselves; large buckets are cut into cells of ``CELL`` lines a side. So no
link within a bucket is lost at any size, and no task holds a bucket.

Of each connected group the occurrence of least (doc_id, hash of the text, line number) stays, all others go.

Texts are not shuffled to find the groups: lines travel as two 64-bit hashes, their fingerprint and
place. Texts are read once more for the lines that may be in a pair, found by a hash of their place before
they are cut into words. Before wide joins a bitmap of fixed
size (``2**25`` bits as rows of longs, broadcast: 8 MB however much data there is) lets the rows pass
that may have a partner; the joins that follow are exact.

Cases: lines without letters or digits always stay; null texts have no lines and stay null; of rows that
share a doc_id each has lines of its own, rows that share id and text are treated alike; a null doc_id
is the least; lines of one or two words are folded when equal only; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored, with_group

BITS, BLOCKS, LANE, SIMILARITY, LONG, SHORT, CODE, CELL = 12, 6, 6, 0.8, 64, 80, 32, 1024
#: The lowest bit of each of the ten lanes of six bits.
ONES = sum(1 << at for at in range(0, 60, LANE))
LEAST = -(1 << 63)


#: All ASCII but letters and digits, and the blocks of spaces and punctuation of other scripts.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F"


def once(**columns: Column) -> Column:
    """The columns as a struct ``made``; nothing is pushed below a generator, so each is computed once."""
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("made")


def norm_of(line: str) -> Column:
    """The line's words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(line), f"[{SEPARATORS}]+", " "))


def codes_of(norm: str | Column) -> tuple[Column, Column]:
    return F.xxhash64(norm).alias("c1"), F.xxhash64(F.lit(1), norm).alias("c2")


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy, line_no, line, words, norm, c1, c2)`` of each line with letters or digits; norm is its words with spaces
    between them, equal lines have equal c1 and c2."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")  # hashed before it is cut, once
    lines = texts.select("doc_id", "copy", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.filter(F.col("line").rlike(f"[A-Z]|[^{SEPARATORS}]")).select("*", norm_of("line").alias("norm"))
    return found.select("*", F.split("norm", " ").alias("words"), *codes_of("norm"))


def at() -> Column:
    """An occurrence's hash, by which its line is found again before any line is cut into words."""
    return F.xxhash64("doc_id", "copy", "line_no")


def place() -> Column:
    """(doc_id, copy, line_no) as one number of that order; a null id comes first."""
    number = lambda c: c.cast("decimal(38,0)")
    doc = F.coalesce(number(F.col("doc_id")), F.lit("-9223372036854775809").cast("decimal(38,0)"))
    low = number(F.shiftrightunsigned("copy", 33)) * F.lit(1 << 31).cast("decimal(11,0)") + number(F.col("line_no"))
    return number(doc * F.lit(1 << 62).cast("decimal(19,0)") + low)


def line_facts(lines: DataFrame) -> DataFrame:
    """``(c1, c2, doc_id, copy, line_no, size, fp, counts, g0, g1, g2)`` of each of the ``occurrences``; size is the length of
    the line in characters, counts has the words of block k in bits 10 k on, g0 to g2 the codes of two blocks each.

    A line's hashes are sorted with the blocks' edges among them, so a block is a slice; nothing is shuffled. Of long
    lines the edges span the least half, quarter, ... of all hashes. Words are summed in lanes of six bits, one long for each block.
    """
    own = ["c1", "c2", "doc_id", "copy", "line_no", "size"]
    hashes = F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))  # words are hashed as they are cut, no row holds them
    rows = lines.select(*own[:5], F.char_length("norm").alias("size"), once(h=hashes)).select(*own, "made.h")
    rows = rows.withColumn("halved", F.greatest(F.lit(0), F.floor(F.log2(F.size("h") / LONG))).cast("int"))
    within = [k * ((1 << 64) // BLOCKS) for k in range(BLOCKS)] + [(1 << 64) - 1]
    edges = [F.call_function("shiftrightunsigned", F.lit(x - (x >> 63 << 64)).cast("bigint"), "halved").bitwiseXOR(F.lit(LEAST)) for x in within]
    rows = rows.select(*own, once(e=F.array(*edges), h=F.sort_array(F.concat("h", F.array(*edges))))).select(*own, "made.*")
    place_ = [F.array_position("h", F.get("e", F.lit(k))).cast("int") for k in range(BLOCKS + 1)]
    rows = rows.select(*own, "h", once(**{f"p{k}": p for k, p in enumerate(place_)})).select(*own, "h", "made.*")
    blocks = {f"b{k}": F.slice("h", F.col(f"p{k}") + 1, F.greatest(F.col(f"p{k + 1}") - F.col(f"p{k}") - 1, F.lit(0))) for k in range(BLOCKS)}
    rows = rows.select(*own, once(**blocks)).select(*own, "made.*")
    zero = F.lit(0).cast("bigint")
    sums = {f"s{k}": F.aggregate(f"b{k}", zero, lambda s, h: s + h.bitwiseAND(F.lit(ONES))) for k in range(BLOCKS)}
    rows = rows.select(*own, *[f"b{k}" for k in range(BLOCKS)], once(**sums)).select(*own, *[f"b{k}" for k in range(BLOCKS)], "made.*")
    fp, counts, codes = zero, zero, [zero, zero, zero]
    for k in range(BLOCKS):  # a lane plus 32 less the majority has its top bit set where the count is a majority
        n = F.size(f"b{k}").cast("bigint")
        lift = (F.lit(31) - F.floor(F.least(n, F.lit(63)) / 2)) * F.lit(ONES)
        lanes = F.col(f"s{k}").bitwiseAND(F.lit((1 << 60) - 1))
        fp = fp.bitwiseOR(F.shiftleft(F.shiftrightunsigned(lanes + lift, LANE - 1).bitwiseAND(F.lit(ONES)), k))
        counts = counts.bitwiseOR(F.shiftleft(F.least(n, F.lit(1023)), 10 * k))
        codes[k // 2] = codes[k // 2].bitwiseOR(F.shiftleft(F.xxhash64(f"b{k}").bitwiseAND(F.lit((1 << CODE) - 1)), CODE * (k % 2)))
    return rows.select(*own, fp.alias("fp"), counts.alias("counts"), *[c.alias(f"g{k}") for k, c in enumerate(codes)])


#: Sets of three, two and one of the blocks (three bits each, 6 is none), with the words that they must hold from bit 9 on.
THREE, TWO, ONE = [[sum(k << 3 * i for i, k in enumerate((*set_, 6, 6)[:3])) + (least << 9) for set_ in combinations(range(BLOCKS), agree)] for agree, least in ((3, 2), (2, 3), (1, 3))]


def keyed(lines: DataFrame) -> DataFrame:
    """``(node, fp, size, key)``: hashes of the sets of blocks on which a line ``(counts, g0, g1, g2)`` is joined, if they hold
    enough words. The sets are rows before they are keys: a small body of code, which the JVM compiles."""
    n = lambda k: F.expr(f"shiftrightunsigned(counts, cast(10 * ({k}) as int)) & 1023")
    total = sum((n(k) for k in range(1, BLOCKS)), n(0))
    some = lambda *sets: F.array(*[F.lit(x) for set_ in sets for x in set_])
    sets = F.when(total < 8, some(THREE)).when(total <= 12, some(THREE, TWO)).when(total < 18, some(TWO)).when(total <= 22, some(TWO, ONE)).otherwise(some(ONE))
    rows = lines.select("node", "fp", "size", "counts", "g0", "g1", "g2", F.explode(sets).alias("set_"))
    at_ = [f"shiftright(set_, {3 * i}) & 7" for i in range(3)]
    code = lambda k: F.expr(f"CASE WHEN ({k}) < 2 THEN shiftrightunsigned(g0, {CODE} * (({k}) & 1)) WHEN ({k}) < 4 THEN shiftrightunsigned(g1, {CODE} * (({k}) & 1)) WHEN ({k}) < 6 THEN shiftrightunsigned(g2, {CODE} * (({k}) & 1)) ELSE 0 END & {(1 << CODE) - 1}")
    return rows.filter(n(at_[0]) + n(at_[1]) + n(at_[2]) >= F.shiftright("set_", 9)).select("node", "fp", "size", F.xxhash64("set_", *[code(k) for k in at_]).alias("key"))


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, bits: int = 25) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: all that are and few others, by a broadcast bitmap of fixed size."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    bitmap = keys.select(slot.alias("s")).selectExpr("shiftright(s, 6) as _w", "shiftleft(1L, cast(s % 64 as int)) as b").groupBy("_w").agg(F.bit_or("b").alias("_b"))
    bitmap = stored(bitmap.coalesce(1), "bitmap")  # at most 2^19 rows of two longs
    marked = rows.withColumn("_s", slot)
    met = marked.join(F.broadcast(bitmap), F.shiftright("_s", 6) == F.col("_w"))
    return met.filter(F.expr("getbit(_b, cast(_s % 64 as int)) = 1")).select(rows.columns)


def _possible(similarity: float, bits: int) -> Column:
    """Whether lengths and fingerprints of x and y leave room for the similarity."""
    return (F.least("x_size", "y_size") >= F.greatest("x_size", "y_size") * similarity) & ((F.bit_count(F.col("x_fp").bitwiseXOR(F.col("y_fp"))) <= bits) | (F.greatest("x_size", "y_size") <= SHORT))


def shared_buckets(lines: DataFrame) -> DataFrame:
    """``(key, node, fp, size, b, b_fp, b_size, n)`` of ``lines(node, fp, counts, size, g0, g1, g2)`` in buckets of n lines, several; b is the bucket's least."""
    rows = keyed(lines)
    many = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "line-keys")
    rows = stored(maybe_in(rows, many, "key"), "line-keyed")
    least = rows.groupBy("key").agg(F.min("node").alias("b"), F.min_by("fp", "node").alias("b_fp"), F.min_by("size", "node").alias("b_size"), F.max("node").alias("_last"), F.count("*").alias("n"))
    return stored(with_group(rows, least.filter("b < _last").drop("_last"), "key"), "line-shared")


def first_pairs(shared: DataFrame, similarity: float, bits: int) -> DataFrame:
    """Pairs ``(a, b)`` of a line and its bucket's least."""
    sides = shared.filter(F.col("node") > F.col("b")).select(F.col("node").alias("a"), "b", F.col("fp").alias("x_fp"), F.col("size").alias("x_size"), F.col("b_fp").alias("y_fp"), F.col("b_size").alias("y_size"))
    return sides.filter(_possible(similarity, bits)).select("a", "b").distinct()


def other_pairs(shared: DataFrame, roots: DataFrame, similarity: float, bits: int) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket that are in other groups of ``roots(node, root)``. The rows of a bucket's most
    frequent group meet the others alone, so a group that is joined already costs work in proportion to its size.
    Of buckets with the same lines one is enough."""
    rows = stored(shared.select("key", "node", "fp", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "line-rooted")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in (0, 1)]
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"), *marks)
    sizes = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("groups"), F.sum("n").alias("n"), *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (0, 1)])
    once = sizes.filter("groups > 1 and n > 2").groupBy("mark0", "mark1", "n").agg(F.min("key").alias("key"), F.first("major").alias("major"))  # pairs of two have met
    met = stored(with_group(rows, stored(once.select("key", "major", F.ceil(F.col("n") / CELL).alias("cells")), "line-mixed"), "key"), "line-met")

    def side(of: DataFrame, c: str, own: str, other: str) -> DataFrame:
        """Each line is in one row (or column) of its bucket's cells and meets all of the other kind."""
        placed = of.withColumn(own, F.pmod(F.xxhash64("node"), "cells")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
        return placed.select("key", own, other, *[F.col(k).alias(f"{c}_{k}") for k in ("node", "root", "fp", "size")])

    pairs = side(met.filter("root != major"), "x", "_row", "_col").join(side(met, "y", "_col", "_row"), ["key", "_row", "_col"]).filter((F.col("x_root") != F.col("y_root")) & _possible(similarity, bits))
    return pairs.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()


def _middle(words: str, front: Column, back: Column, long: Column) -> Column:
    """The words between the first ``front`` and the last ``back``, each with a space after it; of ``long`` lines each
    word as one character, of 20,000 by its hash."""
    kept = F.slice(F.col(words), front + 1, F.greatest(F.size(words) - front - back, F.lit(0)))
    spelled = F.concat(F.array_join(kept, " "), F.when(F.size(kept) > 0, " ").otherwise(""))
    codes = F.array_join(F.transform(kept, lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00)), "")
    return F.when(long, F.decode(F.unhex(codes), "UTF-16BE")).otherwise(spelled)


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b, x, y)`` whose lines of words x and y have the edit similarity, counted in characters, or in
    words where one has more than ``LONG`` (a distance costs the product of the two lengths). Equal words at both ends are
    cut off first, which leaves the distance as it is; small distances are tried before large ones, which cost more."""
    length = lambda c: F.char_length(F.array_join(c, " "))

    def equal(one: Column, two: Column) -> Column:
        at = F.array_position(F.zip_with(one, two, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at > 0, at - 1).otherwise(F.size(one)).cast("int")

    long = F.greatest(F.size("x"), F.size("y")) > LONG
    most = F.floor(F.when(long, F.greatest(F.size("x"), F.size("y"))).otherwise(F.greatest(length("x"), length("y"))) * (1 - similarity) + 1e-9).cast("int")
    rows = pairs.select("a", "b", "x", "y", once(long=long, most=most, front=equal(F.col("x"), F.col("y")), back=equal(F.reverse("x"), F.reverse("y")))).select("a", "b", "x", "y", "made.*")
    back = F.least(F.col("back"), F.least(F.size("x"), F.size("y")) - F.col("front"))
    rows = rows.select("a", "b", "most", once(**{c: _middle(c, F.col("front"), back, F.col("long")) for c in ("x", "y")})).select("a", "b", "most", "made.*")
    rows = rows.filter("abs(char_length(x) - char_length(y)) <= most")
    within = lambda k: F.expr(f"levenshtein(x, y, CASE WHEN most <= 2 * {k} THEN most ELSE {k} END) >= 0")
    small = F.when(within(16), True)
    for k in (64, 256, 1024, 4096):  # a step goes to ``most`` at once where that is at most twice its own, and is the last one then
        small = small.when(F.col("most") <= k // 2, False).when(within(k), True)
    return rows.filter(small.when(F.col("most") <= 8192, False).otherwise(F.expr("levenshtein(x, y, most) >= 0"))).select("a", "b")


def regrouped(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` with the groups joined that ``links(a, b)`` join: of the groups only their roots are gone through again."""
    for c in ("a", "b"):
        of = roots.select(F.col("node").alias(c), F.col("root").alias("_root"))
        links = links.join(of, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    tops = stored(components(links.select("a", "b")), "line-tops")
    moved = with_group(roots, tops.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left")
    return moved.select("node", F.coalesce("_top", "root").alias("root")).unionByName(tops.join(roots, "node", "left_anti"))


def line_groups(lines: DataFrame, facts: DataFrame, similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """``(c1, c2, keep)``: for each line of a group with something to drop, the place of the occurrence that stays."""
    least = [F.min(c).alias(c) for c in ("fp", "counts", "size", "g0", "g1", "g2")]
    distinct = facts.groupBy("c1", "c2").agg(F.min(place()).alias("first"), F.min(at()).alias("at"), F.count("*").alias("n"), *least)
    distinct = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "*"), "lines")  # the node numbers are fixed from here on
    shared = shared_buckets(distinct.select("node", "fp", "counts", "size", "g0", "g1", "g2"))

    first = stored(first_pairs(shared, similarity, bits), "line-pairs")
    # the lines of either step, so that texts are read once: pairs of two have met in the first
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.filter("n > 2").select("node")).distinct()
    wanted = stored(distinct.join(nodes, "node", "left_semi").select("node", "at", "c1", "c2"), "line-wanted")
    found = maybe_in(lines.select(at().alias("at"), "line"), wanted, "at").join(wanted, "at").select("node", "c1", "c2", once(norm=norm_of("line"))).select("node", "c1", "c2", "made.norm")
    same = [F.col(c) == x for c, x in zip(("c1", "c2"), codes_of("norm"), strict=True)]
    texts = stored(found.filter(same[0] & same[1]).groupBy("node").agg(F.first("norm").alias("norm")), "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        text = lambda node, norm: texts.select(F.col("node").alias(node), F.col("norm").alias(norm))
        both = pairs.join(text("a", "x"), "a").join(text("b", "y"), "b")  # cut into words after the joins: arrays of them are far larger
        return stored(alike(both.select("a", "b", *[F.split(c, " ").alias(c) for c in ("x", "y")]), similarity), "line-links")

    roots = stored(components(verified(first)), "line-roots")
    more = stored(other_pairs(shared, roots, similarity, bits).join(first, ["a", "b"], "left_anti"), "line-pairs")
    if not more.isEmpty():
        roots = stored(regrouped(roots, verified(more)), "line-roots")
    member = distinct.drop("at", "fp", "counts", "size", "g0", "g1", "g2").join(roots, "node", "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "node"))
    member = stored(member, "line-members")
    return with_group(member, member.groupBy("root").agg(F.min("first").alias("keep")), "root").select("c1", "c2", "keep")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_lines, n_kept, text)`` of each row of ``docs(doc_id, text)``, text without the dropped lines."""
    lines = occurrences(docs)  # read again where words are needed: a table of them takes more disk than the input
    facts = stored(line_facts(lines), "line-facts")
    groups = stored(line_groups(lines, facts, **options), "line-groups")
    # a line may be a large share of all: the join's exchanges are its own, so Spark splits them
    gone = (
        facts.select("c1", "c2", "doc_id", "copy", "line_no").join(groups.withColumnsRenamed({"c1": "g1", "c2": "g2"}), (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2")))
        .filter(place() != F.col("keep")).groupBy(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")).agg(F.collect_set("line_no").alias("gone"))
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_copy")), "left")
    rows = rows.select("doc_id", "text", "gone", once(lines=F.split("text", "\n"))).select("doc_id", "text", "gone", "made.lines")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # by a hash set, in order
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return rows.select("doc_id", n.cast("bigint").alias("n_lines"), (n - F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0))).cast("bigint").alias("n_kept"), text.alias("text"))
