"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

Items are cut into segments of at most ``SEGMENT`` words and indexed by word. Every text is read as
passages of twice that length, each half over the next, so that any segment stands whole in some
passage. A segment's score for a passage is its BM25 sum over the words they share, divided by the
sum over all its own words: 1 means that the passage holds the whole segment. All segments of at
least ``threshold`` are retrieved. A segment's heaviest words are its essential ones; a passage that
misses more than ``1 - threshold`` of their weight cannot reach the threshold, and passages of which
that holds for every segment are passed over at once (in numpy). The others are searched by WAND,
which skips blocks of postings by their largest weights. What is found is verified in the text around the passage: of the five-word shingles
of the whole item, or of its question and of its answer each, at least ``overlap`` must occur there.
The answer is the last sentence of the item, the question what stands before; one sentence is a
question alone. A changed word of a short answer thus does not hide an item that is there else.

The index of one round holds at most ``shard`` items and about 16 MB of text; larger benchmarks take several rounds over the
documents, so what is sent to the executors never grows with the benchmark.

Cases: null and blank texts and items hold nothing and match nothing; items of fewer than five words
are one shingle; equal items are each reported; repeated documents each give their rows; an empty
benchmark gives no rows and drops no document. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pages import with_global_rank
from .common import shingles, slices, stored, whole_row, word_hashes

SEGMENT, BLOCK, K1, B = 64, 32, 1.2, 0.75
THRESHOLD, OVERLAP, SHARD = 0.7, 0.8, 20_000
SHARD_BYTES = 1 << 24
ESSENTIAL = 0.35  # weight of a segment's essential words beyond what it may miss
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one; a single sentence has no answer."""
    cuts = [m.end() for m in _SENTENCE.finditer(text.strip())]
    return (text.strip()[: cuts[-1]], text.strip()[cuts[-1] :]) if cuts else (text.strip(), "")


class Index:
    """Postings of item segments by word, in blocks with their largest normalised weights."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items = [i for i, _ in items]
        halves = [question_answer(t or "") for _, t in items]
        self.need: list[list[np.ndarray]] = []
        self.whole: list[np.ndarray] = []
        segments: list[np.ndarray] = []
        self.of: list[int] = []
        self.words_of: list[int] = []
        words, where = word_hashes(pa.array([t for _, t in items], pa.string()))
        for n, (q, a) in enumerate(halves):
            own = words[where[n] : where[n + 1]]
            self.words_of.append(len(own))
            qw, aw = (word_hashes(pa.array([x]))[0] for x in (q, a))
            self.need.append([shingles(x, min(5, len(x))) for x in (qw, aw) if len(x)] if len(own) else [])
            self.whole.append(shingles(own, min(5, len(own))))
            parts = -(-len(own) // SEGMENT)
            for part in np.array_split(own, parts) if parts else []:
                segments.append(part)
                self.of.append(n)
        self.sizes = [[len(x) for x in (word_hashes(pa.array([q]))[0], word_hashes(pa.array([a]))[0]) if len(x)] for q, a in halves]
        mean = np.mean([len(s) for s in segments]) if segments else 1.0
        counts = [np.unique(s, return_counts=True) for s in segments]
        vocab, df = np.unique(np.concatenate([c[0] for c in counts]), return_counts=True) if counts else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.vocab = vocab
        idf = np.log(1 + (len(segments) - df + 0.5) / (df + 0.5))
        post: list[list[tuple[int, float]]] = [[] for _ in vocab]
        essential: list[list[tuple[int, float]]] = [[] for _ in vocab]
        self.least: list[float] = []  # essential weight that a passage must hold
        for s, (w, tf) in enumerate(counts):
            at = np.searchsorted(vocab, w)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segments[s]) / mean))
            weight /= weight.sum()
            for t, v in zip(at.tolist(), weight.tolist()):
                post[t].append((s, v))
            heavy = np.argsort(-weight, kind="stable")
            heavy = heavy[: 1 + np.searchsorted(np.cumsum(weight[heavy]), 1 - threshold + ESSENTIAL)]
            for t, v in zip(at[heavy].tolist(), weight[heavy].tolist()):
                essential[t].append((s, v))
            self.least.append(float(weight[heavy].sum()) - (1 - threshold) - 1e-6)
        sizes = np.array([len(e) for e in essential], np.int64)
        self.e_start, self.e_size = np.cumsum(sizes) - sizes, sizes
        self.e_seg = np.array([s for e in essential for s, _ in e], np.int64)
        self.e_weight = np.array([v for e in essential for _, v in e])
        self.least = np.array(self.least)
        self.segs = [[s for s, _ in p] for p in post]
        self.weights = [[v for _, v in p] for p in post]
        self.block_max = [[max(v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)] for v in self.weights]
        self.most = np.array([max(v) for v in self.weights], np.float32)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        if not len(self.vocab):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)

    def possible(self, terms: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(text, begin)`` of the passages that hold enough essential words of some segment.

        Passage k of a text has its words from k * SEGMENT on, twice SEGMENT of them.
        """
        at = np.flatnonzero(terms >= 0)
        at = at[self.e_size[terms[at]] > 0]
        text = np.searchsorted(where, at, side="right") - 1
        n_passages = np.maximum(1, -(-(np.diff(where) - SEGMENT) // SEGMENT))
        first = np.cumsum(n_passages) - n_passages
        half = (at - where[text]) // SEGMENT  # a word stands in passage half and in the one before
        v = len(self.vocab)
        pairs = [np.zeros(0, np.int64)]
        for k in (half, half - 1):
            ok = (k >= 0) & (k < n_passages[text])
            pairs.append((first[text[ok]] + k[ok]) * v + terms[at[ok]])
        own = np.unique(np.concatenate(pairs))
        passage, t = own // max(1, v), own % max(1, v)
        size = self.e_size[t]
        post = np.repeat(self.e_start[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(passage, size) * len(self.least) + self.e_seg[post]
        keys, inverse = np.unique(key, return_inverse=True)
        held = np.bincount(inverse, self.e_weight[post], len(keys))
        good = np.unique(keys[held >= self.least[keys % max(1, len(self.least))]] // max(1, len(self.least)))
        text = np.searchsorted(first, good, side="right") - 1
        return text, where[text] + SEGMENT * (good - first[text])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all segments with a score of at least ``threshold`` for a set of terms."""
        cursor = [[self.segs[t][0], 0, t] for t in terms]  # segment, position, term
        most, out = self.most, []
        threshold -= 1e-9
        while cursor:
            cursor.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursor):
                total += most[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            target = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == target:
                pivot += 1
            bound, edge = 0.0, 1 << 60
            for c in cursor[: pivot + 1]:  # each list's block that may hold the target
                segs = self.segs[c[2]]
                b, last = c[1] // BLOCK, (len(segs) - 1) // BLOCK
                while b < last and segs[min(len(segs), (b + 1) * BLOCK) - 1] < target:
                    b += 1
                end = segs[min(len(segs), (b + 1) * BLOCK) - 1]
                if end >= target:
                    bound += self.block_max[c[2]][b]
                    edge = min(edge, end)
            if bound >= threshold:
                if cursor[0][0] == target:
                    score = sum(self.weights[t][p] for s, p, t in cursor[: pivot + 1])
                    if score >= threshold:
                        out.append((target, score))
                    goal = target + 1
                else:
                    goal = target
            else:
                goal = max(target + 1, min(edge + 1, cursor[pivot + 1][0] if pivot + 1 < len(cursor) else 1 << 60))
            kept = []
            for k, c in enumerate(cursor):
                if k <= pivot and c[0] < goal:
                    segs, p = self.segs[c[2]], c[1]
                    while p < len(segs) and segs[p] < goal:
                        p += BLOCK if p + BLOCK < len(segs) and segs[p + BLOCK] < goal else 1
                    if p == len(segs):
                        continue
                    c[0], c[1] = segs[p], p
                kept.append(c)
            cursor = kept
        return out

    def matches(self, words: np.ndarray, where: np.ndarray, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """``(text, item, score, question overlap, answer overlap)`` of each verified match of some texts."""
        terms = self.lookup(words)
        text, begin = self.possible(terms, where)
        end = np.minimum(begin + 2 * SEGMENT, where[text + 1])
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k in range(len(text)):
            own = np.unique(terms[begin[k] : end[k]])
            d = int(text[k])
            for s, score in self.search(own[own >= 0].tolist(), self.threshold):
                item = self.of[s]
                wide = self.words_of[item] + SEGMENT
                near = words[max(where[d], begin[k] - wide) : min(where[d + 1], end[k] + wide)]
                shares = []
                for need, size in zip(self.need[item], self.sizes[item]):
                    have = shingles(near, min(5, size))
                    shares.append(float(np.isin(need, have).mean()))
                whole = np.isin(self.whole[item], shingles(near, min(5, self.words_of[item]))).mean()
                if shares and (min(shares) >= overlap or whole >= overlap):
                    key = (d, item)
                    new = (score, shares[0], shares[-1] if len(shares) > 1 else shares[0])
                    found[key] = max(found.get(key, new), new)
        return [(d, self.items[i], *v) for (d, i), v in found.items()]


def _shards(benchmark: DataFrame, shard: int, threshold: float) -> Iterator[Index]:
    """Indexes of at most ``shard`` items and about ``SHARD_BYTES`` each, read one after the other from the item table.
    Items are dealt by their rank, so that repeated ones do not meet in one."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(trim(text)) > 0")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // shard), -(-(size or 0) // SHARD_BYTES))
    ranked = items if parts == 1 else stored(with_global_rank(items, "item_id", "text"), "items")
    for k in range(parts if n else 0):
        part = items if parts == 1 else ranked.filter(F.pmod("rank", F.lit(parts)) == k)
        yield Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], threshold)


def _search(index: Index, overlap: float):
    @F.arrow_udf("array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        for text in batches:
            out: list = [None] * len(text)
            for at, part in slices(text):
                words, where = word_hashes(part)
                for d, *row in index.matches(words, where, overlap):
                    out[at + d] = [*(out[at + d] or []), dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), row))]
            yield pa.array(out, kind)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of each item found in a text."""
    out = None
    for index in _shards(benchmark, shard, threshold):
        found = docs.select("doc_id", _search(index, overlap)("text").alias("m")).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = "item_id bigint, score double, question_overlap double, answer_overlap double"
        out = docs.select("doc_id").limit(0).selectExpr("doc_id", *[f"cast(null as {k.split()[1]}) as {k.split()[0]}" for k in kinds.split(", ")])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard: int = SHARD) -> DataFrame:
    """``docs`` without the documents in which an item was found."""
    out = docs.select(whole_row(docs), "text")
    for index in _shards(benchmark, shard, threshold):
        out = out.withColumn("items", _search(index, overlap)("text")).filter("items is null").drop("items")
    return out.select("row.*")
