"""Mixing sources to target weights by the cube method (balanced sampling).

Each document gets an expected number of copies, target / size of its source, between 0 and 2. The
whole part is taken surely; the fraction is an inclusion probability. The flight phase moves the
vector of probabilities through the null space of the balancing constraints (words and documents of
the source), so that both totals stay exactly what they were, until a document reaches 0 or 1.

A source may hold any share of the rows, so it is cut into blocks of about ``block`` documents by a
hash of the id (and, among equal rows, of their number). Each block flies alone and leaves at most two documents between 0 and 1; those few
meet in coarser blocks, and so on until one block per source is left. There the landing phase rounds
at most two documents, so a source misses its target by less than twice its largest document.

Cases: null or blank texts have size 0 and are never repeated; a null source is a source of its own,
the last; sources of no words have target 0; repeated rows count each; other columns are ignored by
``mix_plan`` and kept by ``mix``. Reruns agree, as all chances come from hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_row

BLOCK, RUN = 4096, 10_000
_EPS = 1e-9


def words_in(text: str = "text") -> Column:
    """Number of runs without ASCII white space; null gives 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes dealt by the repeating weights, in code-point order,
    null last; what is above ``most`` times a source's size goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), share * sum(n for _, n in order), {}
    free = [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * size[s])
        left -= sum(most * size[s] for s in over)
        free = [s for s in free if s not in out]
    return {s: float(t) for s, t in out.items()}


def fly(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase of one block with the constraints sum(x) and sum(x * size); at most two stay fractional."""
    x, rng = p.tolist(), np.random.default_rng(seed)
    size = size.tolist()
    waiting = [i for i in range(len(x)) if _EPS < x[i] < 1 - _EPS][::-1]
    chance = iter(rng.random(2 * len(x) + 2).tolist())
    live: list[int] = []
    while True:
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        if len(live) < 3:
            return np.array(x)
        i, j, k = live
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])  # null vector of the two constraints
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - x[a]) / d if d > 0 else x[a] / -d for a, d in zip(live, u) if d)
        down = min(x[a] / d if d > 0 else (1 - x[a]) / -d for a, d in zip(live, u) if d)
        move = up if next(chance) * (up + down) < down else -down
        for a, d in zip(live, u):
            x[a] += move * d
        stay = []
        for a in live:
            if x[a] < _EPS:
                x[a] = 0.0
            elif x[a] > 1 - _EPS:
                x[a] = 1.0
            else:
                stay.append(a)
        live = stay


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Landing phase: of the few roundings left, the one whose words come nearest to the expected ones."""
    x = p.copy()
    open_ = np.flatnonzero((x > _EPS) & (x < 1 - _EPS))
    due = float((x[open_] * size[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[a] for b, a in enumerate(open_) if m >> b & 1) - due), m))
    for b, a in enumerate(open_):
        x[a] = best >> b & 1
    return x


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["seed", "doc_id", "size", "p"], kind="stable").reset_index(drop=True)
    seed = int(pdf["seed"].iloc[0]) & 0x7FFFFFFF
    p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(np.int64)
    x = fly(p, size, seed + 1_000_003 * (int(pdf["block"].iloc[0]) + 1))
    if pdf["blocks"].iloc[0] == 1:
        x = land(x, size)
    return pdf.assign(p=x)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source)`` for each row of ``docs(doc_id, text, source)``.

    ``taken`` is 0, 1 or 2 times ``size``. The table of sources comes to the driver; it is one row per
    source, and more than ``100000`` sources are refused.
    """
    facts = stored(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size")), "sizes"
    )
    totals = facts.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(100_001).collect()
    if len(totals) > 100_000:
        raise ValueError("more than 100000 sources")
    spark = docs.sparkSession
    due = targets([(r.source, r.n) for r in totals], weights, share, most)
    schema = "source string, source_size bigint, target double, source_rows bigint"
    plan = spark.createDataFrame([(r.source, r.n, due.get(r.source, 0.0), r.rows) for r in totals], schema)
    rows = facts.join(F.broadcast(plan), facts.source.eqNullSafe(plan.source)).drop(plan.source)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", copies).withColumn("sure", F.floor("copies")).withColumn("p", F.col("copies") - F.col("sure"))
    rows = rows.withColumn("seed", F.xxhash64(F.coalesce("source", F.lit("\0")), F.col("source").isNull()))
    columns = ["doc_id", "source", "size", "source_size", "target", "sure", "p", "seed", "block", "blocks"]
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / block))
    # equal rows are counted and dealt out by their number, so that no block gets all copies of a row
    alike = rows.groupBy(*[c for c in columns if c not in ("block", "blocks")], blocks.cast("bigint").alias("blocks")).agg(F.count("*").alias("n"))
    runs = alike.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))).alias("from")).repartition(F.xxhash64("doc_id", "source", "size", "from"))
    rows = runs.select("*", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + RUN) - 1)).alias("nth"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.col("blocks"))).select(columns)
    done = None
    left = max([-(-r.rows // block) for r in totals], default=1)
    while True:
        flown = stored(rows.groupBy("seed", "block").applyInPandas(_block, rows.schema), "flown")
        if left <= 1:
            done = flown if done is None else done.unionByName(flown)
            break
        fixed = (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
        done = flown.filter(fixed) if done is None else done.unionByName(flown.filter(fixed))
        left = -(-left // (block // 2))
        fewer = F.ceil(F.col("blocks") / (block // 2))
        rows = flown.filter(~fixed).withColumn("blocks", fewer.cast("bigint")).withColumn("block", F.pmod(F.col("block"), F.col("blocks"))).select(columns)
    taken = (F.col("sure") + F.when(F.col("p") > 0.5, 1).otherwise(0)) * F.col("size")
    return done.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows that share an id are taken as their mean, in whole copies.

    Sources that are taken a whole number of times need no decision per document; only the texts of
    the others are shuffled, to meet theirs.
    """
    full = stored(mix_plan(docs, **options), "mix-plan")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = full.groupBy("source").agg(F.max(ratio).alias("_ratio")).select(F.col("source").alias("_psource"), "_ratio", (F.abs(F.col("_ratio") - F.round("_ratio")) < _EPS).alias("_whole"))
    sources = docs.sparkSession.createDataFrame(sources.collect(), "_psource string, _ratio double, _whole boolean")  # mix_plan bounds them
    plan = full.filter("size > 0").join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_psource"))).filter("not _whole")
    plan = plan.groupBy("doc_id", "size", "source").agg(F.avg(F.col("taken") / F.col("size")).alias("_n"))
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("bigint").alias("_id"), words_in().alias("_size"), F.col("source").cast("string").alias("_source"))
    keyed = keyed.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_psource"))).drop("_psource")
    even = keyed.filter("_whole and _size > 0").withColumn("_n", F.col("_ratio"))
    keyed = keyed.filter("not _whole")
    met = keyed.join(
        plan.select(F.col("doc_id").alias("_pid"), F.col("size").alias("_psize"), F.col("source").alias("_psource"), "_n"),
        F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_size") == F.col("_psize")) & F.col("_source").eqNullSafe(F.col("_psource")),
    )
    met = met.select("row", "_n").unionByName(even.select("row", "_n"))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.round("_n").cast("int")))).select("row.*")
