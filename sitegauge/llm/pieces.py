"""SentencePiece ids of whole texts by tables of distinct chunks, and texts from ids.

A chunk is a marked word: a text is cut before each space that follows neither a space nor the marker
itself and does not end the text. Where no piece of the model has its marker inside, no merge goes over
such a cut, and as the model's normalizer leaves texts as they are and puts a marker in front, a chunk
encodes alone as it does in the text. Both are read off the model's file; if either fails, whole texts
are the chunks, and the rest goes the same way.

Texts are taken in runs of about ``run_bytes`` (a longer text is a run of its own). A run becomes a table of its
distinct chunks and, for each text, the numbers of its chunks by position; the library segments each
distinct chunk once, and the ids are joined back by position. Runs stay where they were read: nothing is
shuffled, a lost task is done again from its input, and a task holds one run. One table for the whole
corpus was built first: its rows, one for each chunk and run, and the numbers of all positions
take more disk on their way than the texts do (see the README).

Cases: null is the empty text, which has no ids; every row gives a row, repeated ones too; a text without
spaces is one chunk, of any length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_counts import default_model

MARK = "▁"
_CUT = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.S)
_models: dict = {}


def _model(path: str):
    """The processor and whether its texts may be cut into chunks; loaded once per worker."""
    if path not in _models:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(sp.serialized_model_proto())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        own = any(p.type == p.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in model.pieces)
        _models[path] = sp, bool(plain and not own and not trainer.treat_whitespace_as_suffix and trainer.model_type == trainer.BPE)
    return _models[path]


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of each text as lists, and which text each list belongs to; an empty text has none."""
    odd = pc.or_(pc.match_substring_regex(texts, f"^ | $|[ {MARK}] "), pc.equal(pc.binary_length(texts), 0))
    places = np.arange(len(texts))
    flags = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rest = pa.array([_CUT.split(t) if t else [] for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([plain, rest]), np.concatenate([places[~flags], places[flags]])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode_run(texts: pa.Array, path: str) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of the texts of one run, and which text each list belongs to."""
    sp, cut = _model(path)
    parts, order = chunks(texts) if cut else (pa.array([[t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string())), np.arange(len(texts)))
    table = parts.flatten().dictionary_encode()
    found = sp.encode(table.dictionary.to_pylist(), num_threads=1)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    at = table.indices.to_numpy()  # the chunk at each position
    ends = np.concatenate([[0], np.cumsum(sizes[at])])
    place = np.repeat((begins[at] - ends[:-1]).astype(np.int32), sizes[at])
    place += np.arange(len(place), dtype=np.int32)
    ids = flat[place]
    counts = pc.list_value_length(parts).to_numpy()
    return _lists(ids, ends[np.concatenate([[0], np.cumsum(counts)])]), order


def encode(docs: DataFrame, model: str | None = None, run_bytes: int = 1 << 23) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``docs(doc_id, text)``: the library's ids without begin and end."""
    path = model or default_model()

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, order = encode_run(table.column("text"), path)
        return pa.record_batch([table.column("doc_id").take(pa.array(order)), ids], ["doc_id", "ids"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
            start = 0
            while start < len(sizes):
                before = int(sizes[start - 1]) if start else 0
                end = min(int(np.searchsorted(sizes, before + run_bytes - size)) + 1, len(sizes))
                held.append(batch.slice(start, end - start))
                size += int(sizes[end - 1]) - before
                start = end
                if size >= run_bytes:
                    yield run(held)
                    held, size = [], 0
        if held:
            yield run(held)

    out = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encoded, out)


def decode(ids: DataFrame, model: str | None = None) -> DataFrame:
    """``ids(doc_id, ids)`` with ``text``, as the library decodes them."""
    path = model or default_model()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sp, _ = _model(path)
        for batch in batches:
            out: list[str] = []
            for i in range(0, len(batch), 64):  # lists of numbers are large in Python
                out += sp.decode([x or [] for x in batch.slice(i, 64).to_pylist()], num_threads=1)
            yield pa.array(out, pa.string())

    return ids.withColumn("text", texts("ids"))


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``decoded(doc_id, ids, text)``."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
