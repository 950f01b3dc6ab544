"""Token ids of whole texts in binary files: frequency ranks in byte-aligned variable-length coding.

Each id is replaced by its rank by frequency in the corpus (0 = most frequent, ties to the smaller
id) and written in as few of 1 to 4 bytes as it needs. The lengths of four ranks stand in one control
byte; control bytes and data bytes are kept apart, so that numpy decodes a block by looking up
lengths in a table and gathering bytes, without a loop over ids.

Below the output folder: ``ranks`` is a table of one row per id (bounded by the vocabulary), and
``ids/part=K/*`` hold the documents in ascending doc_id order, through the parts as within them.
A file is a run of blocks, each a header (magic, documents, ids, control bytes, data bytes, ids
before the block, crc32 of the rest), doc_ids (int64, with a null mark), lengths (uint32), control
bytes and data bytes, closed by one line feed.

Cases: null counts as the empty text, which has only the end id; documents that share an id each
stand in the file, ordered by their texts; null ids come first; other columns are ignored; an empty
table makes an empty file set.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, stored

MAGIC, HEADER = b"TIDB", struct.Struct("<4sIIIIqI")
END_ID, BLOCK_IDS, BATCH_BYTES = 1, 1 << 19, 1 << 21
#: Bytes of input for each range of doc_ids, and blocks in a file (a block is about 1 MB, a file must stay below 2 GB).
PART_BYTES, FILE_BLOCKS = 1 << 27, 256
_NULL = np.iinfo(np.int64).min
#: Byte lengths of the four ranks that a control byte stands for.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], 1).astype(np.int64)
_models: dict = {}
#: Composed Latin letters, whose lower case is one such letter and which normalizing leaves as they are.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff\u0152\u0153"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Where its pre-tokenizer always cuts at spaces and line feeds and drops them, cuts between letters
    and closing punctuation and lowers case (all probed at the start), the text is cut there, each
    distinct piece of a batch is encoded once and kept for the next ones; else whole texts are encoded.
    At most about ``most`` pieces are kept; when there are more, those seen but once go. Words of Latin
    letters, of which normalizer and pre-tokenizer make one word each in lower case, are joined by spaces and encoded by the library's model with a plain cut at spaces, where that gives the same
    ids (probed, too); each word then ends with the id that ends a word.
    """

    def __init__(self, path: str, most: int = 1 << 17):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.most = most
        self.clear()
        probe = "Ab.  cd'll, EF!? G...h 12. x'. IT'S; 12 \u00e9\u0301 e \u0301x\n<|endoftext|> ?! it's\tok . \ufb01n\u00a0x  Z\n\n9 \u00e9$$$ \u00c9. a&&& b%%% C*** d### \u00d1,%%%"
        parts = self.pieces(pa.array([probe])).flatten().to_pylist()
        trial = [*"abyz", "hello", "unbelievableness", "é", "ñandú", "straße", "réseaux", "zß", "œuvre", "þing", "ÿ", "ÉTÉ", "Ñu", "ŒUVRE", "Þor"]
        self.direct, suffix = False, getattr(self.t.model, "end_of_word_suffix", None)
        if suffix:
            self.plain = Tokenizer(self.t.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.t.get_vocab_size(), bool)
            self.ends[[i for token, i in self.t.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
            flat, size = self._joined(trial)
            self.direct = [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [x.tolist() for x in self.whole(trial)]
        self.cut = self.whole([probe])[0].tolist() == [i for p in parts for i in self.whole([p])[0].tolist()]

    @staticmethod
    def pieces(texts: pa.Array) -> pa.Array:
        """The pieces of each text between spaces, line feeds, and a letter and the punctuation that ends its word."""
        texts = pc.replace_substring(texts, "\n", " ")
        texts = pc.replace_substring_regex(texts, f"([{_LETTERS}])([.,!?;:$&%*#]+)( |$)", "\\1 \\2\\3")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        return pc.split_pattern(texts, " ")

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used = np.zeros(0, bool)
        self.begin, self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _listed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), 2048):
            lists = self._lists(texts[at : at + 2048])
            sizes += map(len, lists)
            ids.append(np.array([i for x in lists for i in x], np.uint32))
        return np.concatenate(ids), np.array(sizes, np.int32)

    def _joined(self, words: list[str], run: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and the number of ids of each."""
        joined = [" ".join(words[at : at + run]).lower() for at in range(0, len(words), run)]
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)]])
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1).astype(np.int32)
        return (flat, size) if len(size) == len(words) and size.sum() == len(flat) else self._listed(words)

    def learn(self, plain: list[str], other: list[str]) -> None:
        """Keep the ids of pieces that are not known yet."""
        (one, n_one), (two, n_two) = self._joined(plain) if plain else self._listed(plain), self._listed(other)
        self.known.update(zip(plain + other, range(len(self.known), len(self.known) + len(plain) + len(other))))
        self.flat, self.size = np.concatenate([self.flat, one, two]), np.concatenate([self.size, n_one, n_two])
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.used = np.concatenate([self.used, np.zeros(len(plain) + len(other), bool)])

    def shrink(self) -> None:
        keep = np.flatnonzero(self.used)
        if len(keep) > self.most // 2:
            return self.clear()
        names, size = list(self.known), self.size[keep]
        at = np.repeat(self.begin[keep] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self.flat, self.size, self.known, self.used = self.flat[at], size, {names[i]: n for n, i in enumerate(keep.tolist())}, np.zeros(len(keep), bool)
        self.begin = (np.cumsum(size) - size).astype(np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._lists(texts)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        if not self.cut:
            ids = self.whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        lists = self.pieces(texts)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        find = lambda: np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int32, len(pieces))
        own = find()
        if len(self.known) + np.count_nonzero(own < 0) > self.most:
            self.used[own[own >= 0]] = True
            self.shrink()
            own = find()
        self.used[own[own >= 0]] = True
        plain = np.asarray(pc.match_substring_regex(coded.dictionary, f"^[{_LETTERS}]+$")) if self.direct else np.zeros(len(pieces), bool)
        new = [np.flatnonzero((own < 0) & kind) for kind in (plain, ~plain)]
        own[np.concatenate(new)] = len(self.known) + np.arange(len(new[0]) + len(new[1]))
        self.learn(*([pieces[i] for i in rows.tolist()] for rows in new))
        own = own[np.asarray(coded.indices)]
        size = self.size[own]
        ends = np.cumsum(size)
        at = np.repeat((self.begin[own] - ends + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        words = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
        upto = np.concatenate([[0], ends])[words]
        return self.flat[at], np.diff(upto, prepend=0)


def _encoder(path: str) -> Encoder:
    if path not in _models:
        _models[path] = Encoder(path)
    return _models[path]


# ---------------------------------------------------------------- coding


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    r = ranks.astype(np.uint32)
    size = 1 + (r > 0xFF) + (r > 0xFFFF).astype(np.int64) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        own = size > k
        data[at[own] + k] = (r[own] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks back, by table look-up."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    if n and at[-1] + size[-1] != len(data):
        raise ValueError("data bytes do not fit the control bytes")
    b = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = b[at].astype(np.uint32)
    for k in range(1, 4):
        own = np.flatnonzero(size > k)
        out[own] |= b[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    control, data = pack(ranks)
    body = doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + control + data
    return HEADER.pack(MAGIC, len(doc_ids), len(ranks), len(control), len(data), start, zlib.crc32(body)) + body


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(doc_ids, lengths, ranks, start)`` of each block of a file; wrong magic, sizes or sums raise."""
    at = 0
    while at < len(content):
        magic, docs, ids, control, data, start, crc = HEADER.unpack_from(content, at)
        at += HEADER.size
        body = content[at : at + 12 * docs + control + data]
        at += len(body) + 1
        if magic != MAGIC or zlib.crc32(body) != crc or at > len(content) or content[at - 1 : at] != b"\n":
            raise ValueError("not a whole block of token ids")
        c = 12 * docs
        yield (
            np.frombuffer(body, "<i8", docs), np.frombuffer(body, "<u4", docs, 8 * docs).astype(np.int64),
            unpack(body[c : c + control], body[c + control :], ids), start,
        )


# ---------------------------------------------------------------- Spark


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Blocks of encoded documents of one range of doc_ids, in order, with ids before each block in the range."""
    encoder, part = _encoder(path), TaskContext.get().partitionId()
    zip_ = zstandard.ZstdCompressor(level=1)
    ids: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = before = number = 0
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])

    def out() -> pa.RecordBatch:
        nonlocal ids, docs, lengths, held, before, number
        join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
        row = [part, number, before, held, join(docs, "<i8"), join(lengths, "<u4"), zip_.compress(join(ids, "<u4"))]
        before, number, ids, docs, lengths, held = before + held, number + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for b in batches:
        for at, text in slices(b.column("text"), BATCH_BYTES):
            flat, size = encoder.encode(text)
            ids.append(np.insert(flat, np.cumsum(size), end_id))
            lengths.append(size + 1)
            docs.append(np.asarray(pc.fill_null(b.column("doc_id").slice(at, len(text)), _NULL)))
            held += len(ids[-1])
            if held >= BLOCK_IDS:
                yield out()
    if docs:
        yield out()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        for x in b.column("ids"):
            c = np.bincount(np.frombuffer(unzip.decompress(x.as_py()), "<u4"))
            n = max(len(c), len(total))
            total = np.pad(total, (0, n - len(total))) + np.pad(c, (0, n - len(c)))
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["id", "n"])


def write_token_ids(docs: DataFrame, path: str, model: str | None = None, end_id: int = END_ID) -> None:
    """Encode each row of ``docs(doc_id, text)``, append ``end_id`` and write the files below ``path``.

    The texts are encoded once, after one shuffle into doc_id ranges. To the driver come the counts
    of ids (bounded by the vocabulary) and the number of ids of each range (one for each task).
    """
    spark, at = docs.sparkSession, model or default_model()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's, mostly of file sizes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-estimate // PART_BYTES), 1 << 17))
    ordered = (
        docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    kinds = "part int, block bigint, before bigint, n bigint, docs binary, lengths binary, ids binary"
    encoded = stored(ordered.mapInArrow(lambda it: _encode(it, at, end_id), kinds), "encoded", codec="uncompressed")
    counts = encoded.select("ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    by_rank = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    sizes = sorted((r.part, r.n) for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n
    sent = spark.sparkContext.broadcast((rank, starts))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, starts = sent.value
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for r in range(len(b)):
                row = {k: b.column(k)[r].as_py() for k in b.schema.names}
                raw = np.frombuffer(unzip.decompress(row["ids"]), "<u4")
                made = block(np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<u4"), rank[raw], starts[row["part"]] + row["before"])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([made], pa.binary())], ["part", "made"])

    made = encoded.sortWithinPartitions("part", "block").mapInArrow(code, "part int, made binary")
    made.select("part", F.col("made").cast("string").alias("value")).sortWithinPartitions("part").write.partitionBy("part").option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(by_rank)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    ranks = spark.read.schema("rank bigint, id bigint").parquet(f"{path}/ranks").toPandas().sort_values("rank")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("content")
    return files, ranks["id"].to_numpy(np.uint32)


def _read(spark: SparkSession, path: str, row, columns: str, kind: list[pa.DataType]) -> DataFrame:
    """A row ``(doc_id, start, n_tokens, row(ids))`` of each document in the files."""
    files, ids_of = _files(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for docs, lengths, ranks, start in blocks(content.as_py()):
                    ids = ids_of[ranks] if len(ranks) else np.zeros(0, np.uint32)
                    begin = np.cumsum(lengths) - lengths
                    last = [row(ids[a : a + n]) for a, n in zip(begin.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NULL), pa.array(start + begin, pa.int64()), pa.array(lengths, pa.int64()), pa.array(last, kind[0])], ["doc_id", "start", "n_tokens", "last"])

    return files.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, last {columns}")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document in the files."""
    return _read(spark, path, lambda ids: ids.astype(np.int64), "array<bigint>", [pa.list_(pa.int64())]).withColumnRenamed("last", "ids")


def token_id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint", [pa.int64()]).withColumnRenamed("last", "ids_crc32")


def token_ids(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (below ``path`` or in scratch) and return the digests read back from them."""
    at = path or scratch(docs.sparkSession, "token-ids")
    write_token_ids(docs, at, **options)
    return token_id_digests(docs.sparkSession, at)
