"""Token counts and files, toxicity, decontamination, line dedup."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import words

from sitegauge.llm import token_ids as ti
from sitegauge.llm.common import shingles, word_hashes
from sitegauge.llm.decontaminate import SEGMENT, Index, _shards, contaminated, decontaminate, question_answer
from sitegauge.llm.token_counts import default_model, parts, token_counts
from sitegauge.llm.toxicity import held_out, toxicity, train, without_toxic

ODD = [(1, None), (2, ""), (3, "Hello, World! <s> it's  é́ 日本語\t x"), (3, "Hello, World! <s> it's  é́ 日本語\t x"), (None, "a b"), (5, "word " * 40000), (6, "x" * 3000), (7, "<|endoftext|> <|EndOfText|> A. b")]


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs(ODD)).collect())
    want = sorted((i or -1, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in ODD)
    assert got == want
    assert token_counts(docs([])).collect() == []
    assert " ".join(parts("ab cd " * 100, 50)).split() == ["ab", "cd"] * 100


def test_token_id_files(spark, docs, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(ti.default_model())
    ti.write_token_ids(docs(ODD), f"file://{tmp_path}/out")
    rows = sorted(ti.read_token_ids(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in ODD], key=lambda i: -1 if i is None else i)
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in ODD)
    assert sorted(r.ids for r in rows) == want
    sums = {(r.start, r.ids_crc32) for r in ti.token_id_digests(spark, f"file://{tmp_path}/out").collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    assert ti.token_ids(docs([])).collect() == []


def test_token_id_files_of_several_tasks(spark, docs, tmp_path):
    """A doc_id range whose encoded blocks are read by several tasks gives several files."""
    rows = [(k, " ".join(words(k, 600))) for k in range(60)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in small}
    encode, sizes = ti._encode, (ti.BLOCK_IDS, ti.BATCH_BYTES)
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        hadoop.set("parquet.block.row.count.limit", "5")
        # as another function than the module's it travels by value, with the small sizes
        ti.BLOCK_IDS, ti.BATCH_BYTES, ti._encode = 500, 2000, lambda *of: encode(*of)
        ti.write_token_ids(docs(rows), f"file://{tmp_path}/many")
    finally:
        ti._encode, (ti.BLOCK_IDS, ti.BATCH_BYTES) = encode, sizes
        for k, v in before.items():
            spark.conf.set(k, v)
        hadoop.unset("parquet.block.row.count.limit")
    files = [f for _, _, names in os.walk(tmp_path / "many" / "ids") for f in names if f.startswith("part-")]
    assert len(files) > 1
    got = sorted(ti.read_token_ids(spark, f"file://{tmp_path}/many").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == list(range(60))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(60)]


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        r = rng.integers(0, 1 << rng.integers(1, 33), n, dtype=np.uint64).astype(np.uint32)
        control, data = ti.pack(r)
        assert np.array_equal(ti.unpack(control, data, n), r)
    made = ti.block(np.array([1, 2]), np.array([2, 1]), np.array([5, 70000, 1], np.uint32), 9) + b"\n"
    assert next(ti.blocks(made))[3] == 9
    with pytest.raises(ValueError):
        list(ti.blocks(made[:-3] + b"??\n"))


def test_encoder_is_the_library(tmp_path):
    e = ti.Encoder(ti.default_model(), most=300)
    for seed in range(6):
        texts = pa.array([" ".join(words(seed, 120)) + ". It's. A--b!! <|endoftext|>", None, "", "Ünï. ß, x y\n\nz..."])
        flat, sizes = e.encode(texts)
        want = [x.tolist() for x in e.whole([t or "" for t in texts.to_pylist()])]
        assert sizes.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_long_texts_score_as_in_one_run():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 1 << 16, (n, 3)).astype(np.int32) for n in (50, 61, 33, 40) * 20]
    model = train(texts, np.arange(80) % 2, np.zeros(80, int), epochs=1)
    for n in (0, 1, 2, 3, 10, 11, 12, 13, 400):
        ids = rng.integers(0, 1 << 16, (n, 3)).astype(np.int32)
        assert model.long_raw(ids, model.tables(), 10) == pytest.approx(model.raw(ids, np.array([0, n]), model.tables())[0])


def test_toxicity(spark, docs):
    good = [(i, " ".join(words(i, 40)), "en", "s") for i in range(400)]
    bad = [(i, " ".join([*words(i, 20), ["idiotic", "scumbag"][i % 2], *words(i + 1, 20)]), "en", "s") for i in range(400, 600)]
    table = docs([*good, *bad, (1000, None), (1001, ""), (None, "x"), (5, good[5][1])])
    labels = spark.createDataFrame([*((i, 0) for i in range(400)), *((i, 1) for i in range(400, 600)), (None, 1), (7, None), (99999, 1)], "doc_id bigint, toxic int")
    rows = toxicity(table, labels).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id >= 400) for r in held) / len(held) > 0.97
    assert all(r.predicted == 0 for r in rows if r.doc_id in (1000, 1001))
    kept = without_toxic(table, labels)
    assert kept.columns == table.columns and 350 < kept.count() < 430
    assert toxicity(docs([]), labels.limit(0)).collect() == []
    assert {r.predicted for r in toxicity(table, labels.limit(0)).collect()} == {0}
    assert table.select(held_out()).count() == 604


BENCH = [(1, "What is the tallest hill of the northern river valley region? It is mount amberfield near kestrel."), (2, "Short item here."), (3, None), (4, ""), (5, " ".join(words(77, 150)) + ". " + " ".join(words(78, 30)) + ".")]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(*b, "x") for b in BENCH], "item_id bigint, text string, score string")
    fill = lambda s: " ".join(words(s, 90))
    rows = [(1, fill(1) + " " + BENCH[0][1].upper() + " " + fill(2)), (2, fill(3)), (3, None), (4, ""), (5, BENCH[0][1].split("?")[0] + fill(4)), (6, fill(5) + "\n" + BENCH[4][1] + fill(6)), (7, "short ITEM here"), (None, BENCH[0][1]), (1, fill(1) + " " + BENCH[0][1])]
    got = sorted((r.doc_id or -1, r.item_id) for r in contaminated(docs(rows), bench).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (6, 5), (7, 2)]
    assert sorted(r.doc_id for r in decontaminate(docs(rows), bench).collect()) == [2, 3, 4, 5]
    assert sorted((r.doc_id or -1, r.item_id) for r in contaminated(docs(rows), bench, shard=1).collect()) == got
    assert contaminated(docs(rows), bench.limit(0)).collect() == [] and decontaminate(docs(rows), bench.limit(0)).count() == 9
    assert contaminated(docs([]), bench).collect() == []


def test_one_changed_word_anywhere(spark, sf):
    """Any one-word change that leaves 0.8 of an item's shingles is found, also in a short last sentence."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = Index(items)
    tried = 0
    for n, (item, text) in enumerate(items):
        own = word_hashes(pa.array([text]))[0]
        for k in range(len(own)):
            changed = own.copy()
            changed[k] = 1
            if np.isin(shingles(own), shingles(changed)).mean() >= 0.8:
                tried += 1
                assert item in {m[1] for m in index.matches(changed, np.array([0, len(own)]), 0.8)}, (item, k)
    assert tried > 100


def test_possible_misses_no_passage():
    """Every passage that scores the threshold for some segment is among those that are searched."""
    rng = np.random.default_rng(6)
    vocabulary = words(6, 80)
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 130)))) for i in range(40)]
    index = Index(items)
    texts = [" ".join([*rng.choice(vocabulary, rng.integers(0, 150)), *items[i % 40][1].split()[: rng.integers(1, 130)], *words(i, 40)]) for i in range(80)] + ["", "x"]
    hashed, where = word_hashes(pa.array(texts))
    terms = index.lookup(hashed)
    got = set(zip(*(x.tolist() for x in index.possible(terms, where))))
    seen = 0
    for d in range(len(texts)):
        for begin in range(int(where[d]), max(int(where[d]) + 1, int(where[d + 1]) - SEGMENT), SEGMENT):
            own = set(terms[begin : min(begin + 2 * SEGMENT, int(where[d + 1]))].tolist()) - {-1}
            total = {}
            for t in own:
                for s, v in zip(index.segs[t], index.weights[t]):
                    total[s] = total.get(s, 0) + v
            if max(total.values(), default=0) >= index.threshold:
                seen += 1
                assert (d, begin) in got
    assert seen > 40


def test_repeated_items_do_not_share_a_shard(docs):
    bench = docs([]).sparkSession.createDataFrame([(7, BENCH[0][1], "x")] * 9, "item_id bigint, text string, score string")
    assert sorted(len(i.items) for i in _shards(bench, 2, 0.5)) == [1, 2, 2, 2, 2]


def test_wand_is_the_plain_sum():
    rng = np.random.default_rng(2)
    vocabulary = words(5, 60)
    index = Index([(i, " ".join(rng.choice(vocabulary, 20))) for i in range(300)])
    for _ in range(60):
        terms = sorted(set(rng.integers(0, len(index.vocab), 25).tolist()))
        total = {}
        for t in terms:
            for s, v in zip(index.segs[t], index.weights[t]):
                total[s] = total.get(s, 0) + v
        for threshold in (0.3, 0.5, 0.7):
            assert {s for s, _ in index.search(terms, threshold)} == {s for s, v in total.items() if v >= threshold - 1e-9}
    assert question_answer("One? Two. Three") == ("One? Two. ", "Three")
