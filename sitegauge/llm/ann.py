"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors (``sample``, or 24 for each part if that is more, of least id hash) makes an exact neighbour graph. The graph is
cut into balanced parts: vectors are halved again and again along their main direction and then moved
to the part that holds most of their neighbours while it has room. A small softmax classifier learns
to tell the part from the vector. It files every vector under its most probable part and sends each
query to its ``probes`` most probable parts, where exact cosines rerank all candidates. The number of
probes is calibrated: on sample vectors that the classifier has not seen, as many as find ``recall``
of their exact neighbours.

Parts are dealt out in blocks of at most ``block`` vectors and ``block`` queries, so that a part may
hold any share of the rows. Each task meets one block of either kind; its top k alone go on.

Cases: vectors that are null or zero, hold null or non-finite components, have a null id or another
length than most vectors take no part; rows with the query's id are no candidates of it; queries that
share an id count once; equal scores go to the smaller id; with fewer than k candidates all come.
Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: At least SAMPLE vectors and SAMPLE_PER_PART for each part are sampled; there are at most 2**MOST_PARTS parts.
SAMPLE, SAMPLE_PER_PART, MOST_PARTS, NEIGHBOURS, BLOCK, RECALL = 6000, 24, 12, 10, 4096, 0.97


def in_order(x: np.ndarray) -> np.ndarray:
    """Row sums added from left to right, as SQL adds up a list: scores are the same to the last digit."""
    return np.cumsum(x, axis=1)[:, -1]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest rows of each row of unit vectors."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 256):
        score = x[a : a + 256] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        out[a : a + 256] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Part of each vector: halvings along main directions, then moves that keep more neighbours together."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        halves = []
        for rows in pieces:
            v = rng.normal(size=x.shape[1])
            centred = x[rows] - x[rows].mean(0)
            for _ in range(12):
                v = centred.T @ (centred @ v)
                v /= np.linalg.norm(v) or 1
            order = rows[np.argsort(centred @ v, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        pieces = halves
    for k, rows in enumerate(pieces):
        part[rows] = k
    room = int(np.ceil((1 + slack) * len(x) / len(pieces)))
    back = [[] for _ in range(len(x))]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            back[j].append(i)
    both = [np.array(graph[i].tolist() + back[i], np.int64) for i in range(len(x))]
    size = np.bincount(part, minlength=len(pieces))
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            near, votes = np.unique(part[both[i]], return_counts=True)  # only parts of neighbours have votes
            stay = votes[near == part[i]].sum()
            votes[(size[near] >= room) & (near != part[i])] = -1
            to = int(near[votes.argmax()]) if len(near) else part[i]
            if votes.max(initial=-1) > stay:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 96, epochs: int = 40, seed: int = 5):
    """A classifier with one hidden layer; its targets are the shares of a vector's neighbours in each part."""
    rng = np.random.default_rng(seed)

    def goal(rows: np.ndarray) -> np.ndarray:
        """Made for one batch at a time: all of it would be the sample times the parts."""
        out = np.zeros((len(rows), parts))
        np.add.at(out, (np.repeat(np.arange(len(rows)), graph.shape[1]), part[graph[rows]].reshape(-1)), 1.0)
        out[np.arange(len(rows)), part[rows]] += max(1, graph.shape[1] // 2)
        return out / out.sum(1, keepdims=True)

    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[rows] @ w[0] * x.shape[1] ** 0.5 + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - goal(rows)) / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ dh * x.shape[1] ** 0.5, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w


def scores(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ w[0] * x.shape[1] ** 0.5 + w[1], 0) @ w[2] + w[3]


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, neighbours: int = NEIGHBOURS) -> tuple[list[np.ndarray], int]:
    """The router and how many parts a query must be sent to."""
    x = _unit(sample)
    held, own = x[::5], np.delete(x, np.s_[::5], axis=0)
    held = held[:2000]  # enough for a quantile
    if len(own) < 4 * parts:
        return train_router(x, np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int64), 1, epochs=1), 1
    graph = neighbour_graph(own, neighbours)
    w = train_router(own, balanced_parts(own, graph, parts), graph, parts)
    filed = scores(w, own).argmax(1)
    near = np.concatenate([np.argsort(-(held[a : a + 64] @ own.T), axis=1)[:, :5] for a in range(0, len(held), 64)])
    rank = np.argsort(np.argsort(-scores(w, held), axis=1), axis=1)  # place of each part for each query
    needed = np.take_along_axis(rank, filed[near], 1).reshape(-1)
    return w, min(parts, 1 + int(np.quantile(needed, recall, method="higher")))


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda c: c != 0)


def nearest(table: DataFrame, query: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding", parts: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest cosine found for each row where ``query`` holds.

    The number of parts grows with the root of the rows, so that a part does, too; it may be given instead.
    """
    rows = table.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("q")).filter(usable("v") & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    spark = table.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows, n = rows.filter(F.size("v") == sizes[0]["dim"]), sizes[0]["count"]
    parts = parts or 1 << int(np.clip(round(np.log2(max(1.0, n**0.5 / 14))), 0, MOST_PARTS))
    chosen = rows.select("id", "v").orderBy(F.xxhash64("id"), "v").limit(max(sample, SAMPLE_PER_PART * parts)).select("v").toArrow()["v"].combine_chunks()
    w, probes = fit(np.asarray(chosen.flatten()).reshape(len(chosen), -1), parts)
    width = len(w[3])

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = scores(w, _unit(np.stack(pdf["v"].to_numpy())))
                order = np.argsort(-s, axis=1, kind="stable")
                pdf["part"] = order[:, 0].astype(np.int32)
                pdf["probes"] = [o if q else None for o, q in zip(order[:, :probes].astype(np.int32), pdf["q"])]
                yield pdf

    filed = stored(rows.mapInPandas(file, "id bigint, v array<double>, q boolean, part int, probes array<int>"), "filed")
    asked = filed.filter("q").groupBy("id").agg(F.min(F.struct("v", "probes")).alias("m")).select(F.col("id").alias("query_id"), "m.*")
    routed = asked.select("query_id", "v", F.explode("probes").alias("part"))
    rows_in = dict(filed.groupBy("part").count().collect())
    queries_in = dict(routed.groupBy("part").count().collect())  # both have a row per part at most
    ceil = lambda n: max(1, -(-n // block))
    plan = spark.createDataFrame([(p, ceil(rows_in.get(p, 0)), ceil(queries_in.get(p, 0))) for p in range(width)], "part int, rbs int, qbs int")
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = routed.join(F.broadcast(plan), "part").select("part", mine("query_id", "qbs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)).alias("rb"), "query_id", "v")
    right = filed.join(F.broadcast(plan), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), F.pmod(F.xxhash64("id", "v"), F.col("rbs")).cast("int").alias("rb"), "id", "v")

    def rerank(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(rs):
            rs = rs.sort_values("id", kind="stable")
            ids, vectors = rs["id"].to_numpy(), np.stack(rs["v"].to_numpy())
            unit = _unit(vectors)
            norm = np.sqrt(in_order(vectors * vectors))
            for a in range(0, len(qs), 256):
                part = qs.iloc[a : a + 256]
                rough = _unit(np.stack(part["v"].to_numpy())) @ unit.T
                for q, v, s in zip(part["query_id"].to_numpy(), part["v"].to_numpy(), rough):
                    s[ids == q] = -np.inf
                    edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    at = np.flatnonzero((s >= edge - 1e-9) & (s > -np.inf))
                    exact = in_order(vectors[at] * v) / (norm[at] * np.sqrt(in_order((v * v)[None])))
                    exact = np.where(np.isfinite(exact), exact, s[at])
                    best = np.lexsort((ids[at], -exact))[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ("part", "qb", "rb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
