"""Toxicity scores of whole texts by a convolutional text classifier, trained in numpy.

Words, their first four and their first five bytes are hashed to ``2**bits`` buckets, each with an
embedding of ``dim`` numbers; a word is the sum of its three. Filters of widths 1, 2 and 3 run over
the words of the text; each filter's largest response (ReLU, max pooling) feeds a
logistic output. The first number of an embedding starts at the log odds of its bucket among the
training texts, the others near zero. Trained by Adam on a bounded sample of labelled rows: at most
``most`` rows and ``most_bytes`` of text of each label, those of least id hash. Very long texts are scored in
runs of words, which share as many words as the widest filter needs.

Thresholds are calibrated by language: a part of the sample is held back, and for each language the
cut of best F1 is taken (the common one where the language has under 40 held-back rows). The language
is guessed from the text's own function words, so the language column is no input. Scores are then
bent so that each language's cut lies at 0.5.

Cases: null and blank texts get the score of a text without words, below 0.5; every row gives a row;
labels that are null or name no document are ignored, several for one id count as their largest; with
no labels of one of the two kinds every score is that of the other kind. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_row, word_hashes

BITS, DIM, FILTERS, WIDTHS, MOST, MOST_BYTES, EPOCHS = 16, 6, 6, (1, 2, 3), 4000, 10 << 20, 5
#: Words of a text that are scored at once.
RUN = 1 << 16
PREFIXES = (4, 5)
#: Function words by which languages are told apart; the last entry of LANGUAGES is for none of them.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with are as be this at by not or from have an but which",
    "de": "der die und das von zu mit den auf für ist im dem nicht ein eine des auch sich als wird bei oder",
    "fr": "le la de et les des un une du en est que dans qui pour sur pas au avec par ne se ou sont",
    "es": "el la de que y los en un las por con una para es del se no al su lo como más pero",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
NONE = np.zeros((0, 1 + len(PREFIXES)), np.int32)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    votes: dict[int, np.ndarray] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        hashes, _ = word_hashes(pa.array([words]))
        for h in hashes.tolist():
            votes.setdefault(h, np.zeros(len(FUNCTION_WORDS), np.float32))[k] = 1
    keys = np.array(sorted(votes), np.uint64)
    return keys, np.stack([votes[int(k)] / votes[int(k)].sum() for k in keys])


def languages(words: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each text: most votes of its function words."""
    keys, votes = _language_table()
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == words)
    total = np.zeros((len(where) - 1, len(FUNCTION_WORDS)))
    np.add.at(total, np.searchsorted(where, hit, side="right") - 1, votes[at[hit]])
    return np.where(total.sum(1) > 0, total.argmax(1), len(FUNCTION_WORDS))


def buckets(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int32)


class Model:
    """Embeddings, filters and output weights; ``tables`` are the embeddings times each filter column."""

    def __init__(self, bits: int = BITS, dim: int = DIM, filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.cuts = bits, np.full(len(LANGUAGES), 0.5)
        self.p = {"e": rng.normal(0, 0.05, (1 << bits, dim)).astype(np.float32), "o": np.full(filters * len(WIDTHS), 0.3, np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            f = rng.normal(0, 0.15, (w, dim, filters)).astype(np.float32)
            f[:, 0, : filters // 2] = 0.8 / w  # half of the filters begin by looking for words of high odds
            self.p[f"f{w}"], self.p[f"b{w}"] = f, np.full(filters, -0.5, np.float32)

    def ids(self, words: np.ndarray) -> np.ndarray:
        return buckets(words, self.bits)

    def pooled(self, ids: np.ndarray, where: np.ndarray, tables: dict | None = None, upto: int | None = None):
        """Largest response of each filter in each text, and all responses; with ``upto`` of its first words alone."""
        n = len(where) - 1
        out, args = [], []
        full = where[1:] > where[:-1]
        starts = where[:-1][full]
        words = None if tables else self.p["e"][ids].sum(1)
        for w in WIDTHS:
            f, b = self.p[f"f{w}"], self.p[f"b{w}"]
            resp = np.empty((len(ids), f.shape[2]), np.float32)
            resp[:] = b
            for k in range(w):
                if tables:
                    part = tables[w][k][ids[:, 0]]
                    for c in range(1, ids.shape[1]):
                        part += tables[w][k][ids[:, c]]
                else:
                    part = words @ f[k]
                # words after the end of a text give nothing
                if k:
                    shifted = np.zeros_like(part)
                    shifted[:-k] = part[k:]
                    for back in range(1, k + 1):
                        ends = where[1:] - back
                        shifted[ends[ends >= where[:-1]]] = 0
                    part = shifted
                resp += part
            top = np.zeros((n, f.shape[2]), np.float32)
            if len(starts):
                top[full] = np.maximum.reduceat(resp[:upto], starts, axis=0)
            out.append(np.maximum(top, 0))
            args.append((resp, top))
        return np.concatenate(out, 1), args

    def raw(self, ids: np.ndarray, where: np.ndarray, tables: dict | None = None) -> np.ndarray:
        z = self.pooled(ids, where, tables)[0] @ self.p["o"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def long_raw(self, ids: np.ndarray, tables: dict | None = None, run: int = RUN) -> float:
        """The same of one text of many words: the largest responses of its runs of words."""
        over = max(WIDTHS) - 1
        top = None
        for start in range(0, max(1, len(ids) - over), run):
            part = ids[start : start + run + over]
            last = start + run + over >= len(ids)
            pool = self.pooled(part, np.array([0, len(part)]), tables, None if last else len(part) - over)[0]
            top = pool if top is None else np.maximum(top, pool)
        z = top @ self.p["o"] + self.p["c"][0]
        return float(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))[0])

    def tables(self) -> dict:
        return {w: [self.p["e"] @ self.p[f"f{w}"][k] for k in range(w)] for w in WIDTHS}

    def bent(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        cut = self.cuts[language]
        return np.where(raw < cut, 0.5 * raw / cut, 0.5 + 0.5 * (raw - cut) / np.maximum(1 - cut, 1e-9)).clip(0, 1)


def train(ids: list[np.ndarray], label: np.ndarray, language: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on the bucket numbers of texts' words with labels 0/1; the sixth part of the rows calibrates."""
    model = Model(seed=seed)
    if not len(label) or label.min() == label.max():
        model.p["o"][:], model.p["c"][0] = 0, -4.0 if not len(label) or label.max() == 0 else 4.0
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(ids))
    held, fit = order[: len(order) // 6], order[len(order) // 6 :]
    seen = np.zeros((2, 1 << model.bits))
    for i in fit:
        seen[label[i], np.unique(ids[i])] += 1
    rows = np.maximum(1, np.bincount(label[fit], minlength=2))
    odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
    sure = np.sqrt(seen.sum(0)) / (2 + np.sqrt(seen.sum(0)))  # rare buckets tell little
    model.p["e"][:, 0] = (odds * sure).clip(-4, 4) / 2
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    weight = np.where(label == 1, 0.5 * len(fit) / rows[1], 0.5 * len(fit) / rows[0]) ** 0.5
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            where = np.concatenate([[0], np.cumsum([len(ids[i]) for i in part])])
            cat = np.concatenate([NONE, *[ids[i] for i in part]])
            pool, args = model.pooled(cat, where)
            z = (pool @ model.p["o"] + model.p["c"][0]).clip(-30, 30)
            dz = ((1 / (1 + np.exp(-z)) - label[part]) * weight[part] / len(part)).astype(np.float32)
            grad = {"o": pool.T @ dz, "c": dz.sum(keepdims=True)}
            touched: list[np.ndarray] = []
            amount: list[np.ndarray] = []
            dpool = np.outer(dz, model.p["o"])
            for n, w in enumerate(WIDTHS):
                f = model.p[f"f{w}"]
                gf, gb = np.zeros_like(f), np.zeros_like(model.p[f"b{w}"])
                resp, top = args[n]
                d = dpool[:, n * f.shape[2] : (n + 1) * f.shape[2]] * (top > 0)
                for r, j in zip(*np.nonzero(d)):
                    at = where[r] + int(resp[where[r] : where[r + 1], j].argmax())
                    gb[j] += d[r, j]
                    for k in range(min(w, where[r + 1] - at)):
                        gf[k, :, j] += d[r, j] * model.p["e"][cat[at + k]].sum(0)
                        touched.extend(cat[at + k].tolist())
                        amount.extend([d[r, j] * f[k, :, j]] * cat.shape[1])
                grad[f"f{w}"], grad[f"b{w}"] = gf, gb
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for key, g in grad.items():
                first[key] = 0.9 * first[key] + 0.1 * g
                second[key] = 0.999 * second[key] + 0.001 * g * g
                model.p[key] -= (rate * first[key] / (np.sqrt(second[key]) + 1e-8)).astype(np.float32)
            if touched:  # embeddings: only those of this batch move (Adagrad)
                rows_, inverse = np.unique(np.array(touched), return_inverse=True)
                g = np.zeros((len(rows_), DIM), np.float32)
                np.add.at(g, inverse, np.array(amount))
                second["e"][rows_] += g * g
                model.p["e"][rows_] -= 0.02 * g / (np.sqrt(second["e"][rows_]) + 1e-6)
    raw = np.zeros(0)
    for part in np.array_split(held, max(1, len(held) // 64)):
        where = np.concatenate([[0], np.cumsum([len(ids[i]) for i in part])]).astype(np.int64)
        raw = np.concatenate([raw, model.raw(np.concatenate([NONE, *[ids[i] for i in part]]), where)])

    def best_cut(rows: np.ndarray) -> float:
        score, truth = raw[rows], label[held][rows]
        order = np.argsort(-score, kind="stable")
        hits = np.cumsum(truth[order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, truth.sum()))
        k = int(f1.argmax())
        low = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 0.02
        return float(np.clip((score[order[k]] + low) / 2, 0.02, 0.98))

    empty = model.raw(NONE, np.array([0, 0]))[0]
    common = best_cut(np.arange(len(held))) if len(held) else 0.5
    for k in range(len(LANGUAGES)):
        own = np.flatnonzero(language[held] == k)
        enough = len(own) >= 40 and 0 < label[held][own].sum() < len(own)
        model.cuts[k] = max(best_cut(own) if enough else common, min(0.98, empty + 0.01))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket numbers of each text's words, and its language."""
    for batch in batches:
        out, language = [], []
        for _, part in slices(batch.column("text")):
            words, where = word_hashes(part, PREFIXES)
            language += languages(words[:, 0], where).tolist()
            own = buckets(words)
            out += [own[where[i] : where[i + 1]].tobytes() for i in range(len(part))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(language, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "toxic", "language", "ids"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, **options) -> Model:
    """Train on labelled documents that are not held out: at most ``most`` and ``most_bytes`` of text of each kind."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    kinds = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    spark = docs.sparkSession
    sample = F.broadcast(kinds[0].unionByName(kinds[1]))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id")
    sizes = own.groupBy("toxic", "doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.first(F.xxhash64("doc_id")).alias("h")).collect()  # at most 2 * most rows
    room, chosen = {0: most_bytes, 1: most_bytes}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        room[r.toxic] -= r["size"] or 0
        if room[r.toxic] >= 0:
            chosen.append((r.doc_id, r.toxic))
    sample = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, toxic int"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(_words, "doc_id bigint, toxic int, language int, ids binary").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows.select(["doc_id", "ids"]).append_column("n", pc.binary_length(rows["ids"])), [("doc_id", "ascending"), ("n", "ascending")]))
    ids = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows["ids"]]
    return train(ids, np.asarray(rows["toxic"]).astype(int), np.asarray(rows["language"]), **options)


def scorer(model: Model):
    """An Arrow function from text to the score of the whole text."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = model.tables()
        for text in batches:
            out = [np.zeros(0)]
            for _, part in slices(text, 1 << 19):
                words, where = word_hashes(part, PREFIXES)
                ids = model.ids(words)
                raw = model.raw(ids, where, tables) if len(ids) <= 2 * RUN or len(part) > 1 else np.array([model.long_raw(ids, tables)])
                out.append(model.bent(raw, languages(words[:, 0], where)))
            yield pa.array(np.concatenate(out), pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs(doc_id, text)``."""
    score = scorer(fit(docs, labels, **options))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more."""
    score = scorer(fit(docs, labels, **options))
    return docs.select(whole_row(docs), score("text").alias("score")).filter("score < 0.5").select("row.*")
