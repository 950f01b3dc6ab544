"""Similarity joins of term vectors that common terms and copies cannot hold up.

Equal vectors are one class, so copies never make pairs. The terms of a vector are ordered from rare to
common; a pair meets at its rarest common term alone, and only there: a term is looked up just while the
rest of the vector from it on is long enough to reach the threshold, in those bands of the other side's
rests that are long enough for it, and a meeting is dropped before its product is worked out if what
follows on both sides, or the number of common terms, can't reach it. So terms that most titles share
are looked up for those vectors alone that have little else. Rows of such a term are dealt to cells of
at most ``CELL`` rows of either side, each pair of cells a key of its own.

Terms travel as 64-bit hashes, classes as two of them. Null keys, terms and weights are not allowed; vectors are as
long as one text's distinct terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import checkpointed

#: Rows of one term and side in a cell.
CELL = 1024
#: Bands of the squared length of a vector's rest.
BANDS = 8
_SLACK = 1e-9  # of bounds against rounding
_FACTS = ("most", "flat", "bits0", "bits1", "alike")


def split_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to the one row of ``facts`` for their key, which any share of them may have: the key is
    altered on both sides, so neither side's earlier partitioning is kept and Spark splits hot partitions."""
    altered = F.concat(F.lit("="), F.col(key).cast("string"))
    return rows.withColumn("_k", altered).join(facts.withColumn("_k", altered).drop(key), "_k", how).drop("_k")


def vectors(rows: DataFrame, counts: DataFrame, k: str) -> DataFrame:
    """``(k, cls, ids, ws, norm)`` of ``rows(k, term, w)``: terms from rare to common by ``counts(term, df)``."""
    item = F.struct("df", F.xxhash64("term").alias("id"), F.col("w").cast("bigint").alias("w"))
    listed = split_join(rows, counts, "term").groupBy(k).agg(F.array_sort(F.collect_list(item)).alias("v"))
    part = lambda f: F.transform("v", lambda x: x[f])
    cls = F.concat_ws("-", F.xxhash64("v").cast("string"), F.xxhash64(F.lit(1), "v").cast("string"))
    return listed.select(k, cls.alias("cls"), part("id").alias("ids"), part("w").alias("ws"), F.sqrt(_squares(part("w"))).alias("norm"))


def _squares(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0).cast("bigint"), lambda acc, w: acc + w * w)


def index(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``left(a, term, w)`` and ``right(b, term, w)``, in the same order of terms."""
    counts = left.select("term").unionAll(right.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    return checkpointed(vectors(left, counts, "a"), "vectors"), checkpointed(vectors(right, counts, "b"), "vectors")


def _classes(vecs: DataFrame) -> DataFrame:
    return vecs.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("ids", "ws", "norm")])


def _postings(classes: DataFrame, least: float) -> DataFrame:
    """Terms of each class as long as the vector from them on has the length ``least``, with that beyond them."""
    bits = F.explode(F.array(F.struct(_bits(0).alias("bits0"), _bits(1).alias("bits1")))).alias("b")  # a generator's column is computed once
    facts = classes.select("*", (F.array_max("ws") / F.col("norm")).alias("most"), (F.array_min("ws") == F.array_max("ws")).alias("flat"), bits).select("*", "b.*")
    facts = facts.withColumn("alike", F.size("ids") - F.bit_count("bits0") - F.bit_count("bits1"))  # terms that share a bit with another
    rows = facts.select("cls", "ids", "ws", "norm", *_FACTS, F.posexplode("ids").alias("i", "id"))
    rest = _squares(F.slice("ws", F.col("i") + 2, F.greatest(F.size("ws") - F.col("i") - 1, F.lit(0)))).cast("double")
    own = F.element_at("ws", F.col("i") + 1) / F.col("norm")
    rows = rows.withColumn("u", own).withColumn("rest", F.sqrt(rest) / F.col("norm")).withColumn("from", F.col("u") * F.col("u") + F.col("rest") * F.col("rest"))
    return rows.filter(F.sqrt("from") >= least - _SLACK)


def _bits(half: int) -> Column:
    """64 of the 128 bits of a vector's terms."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))
    mine = F.filter("ids", lambda x: F.pmod(F.shiftright(x, 6), F.lit(2)) == half)
    return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x)))


def _band(squared: Column) -> Column:
    return F.least(F.floor(squared * BANDS), F.lit(BANDS - 1)).cast("int")


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``(ca, cb, score)`` for all pairs of classes of two indexed sides with a cosine of at least ``least``, above 0."""
    one, two = _postings(_classes(left), least), _postings(_classes(right), least)
    needed = _band(F.least(F.lit(1.0), F.lit(max(least - _SLACK, 0.0) ** 2) / F.col("from")) - _SLACK)
    one = one.withColumn("band", F.explode(F.sequence(F.greatest(needed, F.lit(0)), F.lit(BANDS - 1)))).drop("from")
    two = two.withColumn("band", _band(F.col("from"))).drop("from")
    key = ["id", "band"]
    sizes = one.groupBy(*key).agg(F.count("*").alias("n")).join(two.groupBy(*key).agg(F.count("*").alias("m")), key)
    hot = sizes.filter((F.col("n") > CELL) | (F.col("m") > CELL)).select(F.concat_ws("=", *key).alias("of"), F.ceil(F.col("n") / CELL).alias("rows"), F.ceil(F.col("m") / CELL).alias("cols"))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # few bytes may be many meetings

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row has one cell of its side and meets all of the other."""
        many = split_join(side.withColumn("of", F.concat_ws("=", *key)), hot, "of").na.fill(1, ["rows", "cols"])
        many = many.withColumn(f"_{own}", F.pmod(F.xxhash64("cls"), own)).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return many.drop("rows", "cols", "of").repartition(tasks, *key, "_rows", "_cols")

    renamed = lambda side, s: side.select(*key, "_rows", "_cols", *[F.col(c).alias(f"{c}{s}") for c in ("cls", "ids", "ws", "norm", *_FACTS, "i", "u", "rest")])
    x, y = renamed(dealt(one, "rows", "cols"), "1"), renamed(dealt(two, "cols", "rows"), "2")
    enough = lambda terms: terms * F.col("most1") * F.col("most2") >= least - _SLACK
    shared = sum((F.bit_count(F.col(f"bits{k}1").bitwiseAND(F.col(f"bits{k}2"))) for k in (0, 1)), F.least("alike1", "alike2"))  # no fewer than the common terms
    reach = (F.col("u1") * F.col("u2") + F.col("rest1") * F.col("rest2") >= least - _SLACK) & enough(shared)
    common = F.array_intersect("ids1", "ids2")  # from rare to common, like both
    first = (F.get(common, F.lit(0)) == F.col("id")) & enough(F.size(common))
    met = x.join(y, [*key, "_rows", "_cols"]).filter(F.when(reach, first))  # in this order; parts of a condition have none
    tail = F.arrays_zip(F.slice("ids1", F.col("i1") + 1, F.size("ids1")).alias("id"), F.slice("ws1", F.col("i1") + 1, F.size("ws1")).alias("w"))
    weight = lambda id_: F.coalesce(F.get("ws2", F.array_position("ids2", id_).cast("int") - 1), F.lit(0))
    summed = F.aggregate(tail, F.lit(0).cast("bigint"), lambda acc, t: acc + t["id"].isNotNull().cast("bigint") * t["w"] * weight(t["id"]))
    counted = F.size(common) * F.get("ws1", F.lit(0)) * F.get("ws2", F.lit(0))  # all terms of a vector weigh the same
    dot = F.when(F.col("flat1") & F.col("flat2"), counted).otherwise(summed)
    score = F.explode(F.array(dot / (F.col("norm1") * F.col("norm2"))))  # a generator's column is computed once
    return met.select(F.col("cls1").alias("ca"), F.col("cls2").alias("cb"), score.alias("score")).filter(F.col("score") >= least)


def cosine_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``(a, b, score)`` of term vectors ``(a, term, w)`` and ``(b, term, w)``: all pairs of at least that cosine, copies
    written out. Operators that can do with classes use ``similar``."""
    one, two = index(left, right)
    pairs = similar(one, two, least)
    return pairs.join(one.select(F.col("cls").alias("ca"), "a"), "ca").join(two.select(F.col("cls").alias("cb"), "b"), "cb").select("a", "b", "score")


def nearest(one: DataFrame, two: DataFrame, k: int, least: float, steps: tuple[float, ...] = (0.7, 0.5, 0.35, 0.2)) -> DataFrame:
    """``(a, b, score)``: for each row of an indexed side its ``k`` nearest rows, by the score to 4 decimals, then by id.

    Rows with k matches of at least the first step are settled there, as all matches above are known by then; only the
    others go on to the next step, and those left to the small threshold, at which common terms have to be looked up.
    """
    sizes = two.groupBy("cls").agg(F.count("*").alias("n"), F.min("b").alias("least_b")).withColumnRenamed("cls", "cb")
    order = Window.partitionBy("ca").orderBy(F.desc("score"), "least_b")

    def scored(side: DataFrame, threshold: float) -> DataFrame:
        pairs = similar(side, two, threshold).withColumn("score", F.round("score", 4))
        ranked = pairs.join(sizes, "cb").withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
        return ranked.select("ca", "cb", "score", "n")

    found, left = [], one
    for step in sorted((s for s in steps if s > least), reverse=True):
        above = checkpointed(scored(left, step - 1e-4), "nearest").filter(F.col("score") >= step)
        done = above.groupBy("ca").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("ca")
        found.append(above.join(done, "ca", "left_semi"))
        left = checkpointed(left.join(done.withColumnRenamed("ca", "cls"), "cls", "left_anti"), "left")
    classes = reduce(lambda x, y: x.unionByName(y), [*found, scored(left, least)]).select("ca", "cb", "score")
    members = two.select(F.col("cls").alias("cb"), "b", F.row_number().over(Window.partitionBy("cls").orderBy("b")).alias("_m")).filter(F.col("_m") <= k).drop("_m")
    each = classes.join(members, "cb").join(one.select(F.col("cls").alias("ca"), "a"), "ca")
    ranked = each.withColumn("_rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.filter(F.col("_rn") <= k).select("a", "b", "score")
