"""Rules that apply to all paths with a beginning, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of beginnings that are joined on; a rule goes by the longest that its own beginning has.
LENGTHS = (0, 1, 2, 4, 8, 16, 32)
#: Beginnings of up to so many characters may be those of any share of the paths: their paths are dealt to so many parts,
#: fewer where a site is part of the key.
SHORT, PARTS, SITE_PARTS = 2, 32, 4


def prefix_hits(rows: DataFrame, rules: DataFrame, by: list[str], path: str = "path", prefix: str = "prefix") -> DataFrame:
    """``rows`` with the columns of each of the ``rules`` of the same ``by`` whose ``prefix`` begins their ``path``.

    A path has a row for each length that some rule goes by (seven at most), so a path meets the rules that share
    their first 32, 16, 8, ... characters with it and no others. Rules without a beginning meet all paths
    of their ``by``, each part of the paths as a key of its own.
    """
    size, parts = F.char_length, SITE_PARTS if by else PARTS
    length = F.lit(0)
    for n in LENGTHS[1:]:
        length = F.when(size(prefix) >= n, n).otherwise(length)
    ruled = rules.withColumn("_n", length).withColumn("_key", F.substring(F.col(prefix), F.lit(1), F.col("_n")))
    ruled = ruled.withColumn("_part", F.explode(F.when(F.col("_n") <= SHORT, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    used = rules.select(length.alias("_n")).distinct()  # one row for each length at most
    met = rows.withColumn("_n", F.explode(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: n <= size(path)))).join(F.broadcast(used), "_n", "left_semi")
    met = met.withColumn("_key", F.substring(F.col(path), F.lit(1), F.col("_n"))).withColumn("_part", F.when(F.col("_n") <= SHORT, F.pmod(F.hash(path), F.lit(parts))).otherwise(0))
    return met.join(ruled, [*by, "_n", "_key", "_part"]).filter(F.startswith(F.col(path), F.col(prefix))).drop("_n", "_key", "_part")
