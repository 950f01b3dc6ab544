"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only.

Texts longer than ``split_bytes`` are cut at safe boundaries: a single space between two ASCII
letters. The model makes no piece that goes on over such a space (this is read off its vocabulary;
where it does not hold nothing is cut), and its normalizer leaves ASCII as it is, so the parts' counts
add up to the whole's. Batches for the library hold about ``batch_bytes`` bytes, so that a few very
long texts do not wait for each other.

Cases: null counts as the empty text (0 tokens, 0 bytes); every row gives a row, repeated ones too;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_models: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(path: str):
    """The processor and whether texts may be cut before a word; loaded once per worker."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
        whole = "one two three four"
        apart = sum(len(x) for x in sp.encode(whole.split(" "), num_threads=1))
        _models[path] = sp, not inner and apart == len(sp.encode(whole))
    return _models[path]


def parts(text: str, limit: int) -> list[str]:
    """The text cut at safe spaces into parts of at least ``limit`` characters; the spaces go."""
    out, at = [], 0
    while len(text) - at > 2 * limit and (m := _SAFE.search(text, at + limit)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def counts(texts: list[str | None], path: str, split_bytes: int = 1 << 15, batch_bytes: int = 1 << 18) -> list[int]:
    sp, cut = _model(path)
    out = [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        for part in (parts(text, split_bytes) if cut and len(text or "") > 2 * split_bytes else [text or ""]):
            batch.append(part)
            owner.append(i)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= batch_bytes:
                for o, ids in zip(owner, sp.encode(batch, num_threads=1)):
                    out[o] += len(ids)
                batch, owner, held = [], [], 0
    for o, ids in zip(owner, sp.encode(batch, num_threads=1) if batch else []):
        out[o] += len(ids)
    return out


def token_counts(docs: DataFrame, limit: int = 4096, model: str | None = None, run: int = 256) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row of ``docs(doc_id, text)``."""
    path = model or default_model()

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            out: list[int] = []
            for at in range(0, len(text), run):
                out += counts(text.slice(at, run).to_pylist(), path)
            yield pa.array(out, pa.int64())

    return (
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), count("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
