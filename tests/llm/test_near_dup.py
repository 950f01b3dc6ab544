import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import words

from sitegauge.llm.near_dup import aligned, cells, keep_one, labelled, near_duplicates, shingles, sketch, word_hashes


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_planted_copies_and_edges(docs):
    base = words(1, 200)
    near = base[:50] + ["zzz"] + base[51:]
    moved = base[100:] + base[:100]
    rows = [(5, " ".join(base)), (9, " ".join(base)), (7, " ".join(near).upper() + "!"), (8, " ".join(words(2, 200))), (11, ""), (12, ""), (13, None), (14, None), (15, "one two"), (16, "one two"), (17, "one three"), (18, "?!"), (None, "x y z"), (8, " ".join(words(2, 200))), (20, " ".join(moved))]
    got = classes(near_duplicates(docs(rows)))
    assert got[5] == got[9] == got[7] == 5
    assert got[8] == 8 and got[12] == got[11] == 11 and got[13] == 13 and got[14] == 14 and got[16] == got[15] == 15 and got[17] == 17 and got[18] == 18
    assert len(got) == 13  # one row per id, none for the null id
    kept = sorted(r.doc_id or -1 for r in keep_one(docs(rows)).collect())
    assert kept == [-1, 5, 8, 8, 11, 13, 14, 15, 17, 18, 20]


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == [] and keep_one(docs([])).collect() == []


def brute(a, b):
    """Longest common subsequence over n1 + n2 - it, by the plain table."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    m = t[-1, -1]
    return m / max(1, len(a) + len(b) - m)


def test_alignment_is_the_plain_one():
    r = random.Random(3)
    for _ in range(300):
        a = np.array(r.sample(range(60), r.randint(5, 40)), np.uint64)
        b = a.tolist()
        for _ in range(r.randint(0, 8)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 2)] = [r.randrange(100, 200)] * r.randint(0, 1)
            if r.random() < 0.3 and len(b) > 4:
                b = b[2:4] + b[:2] + b[4:]
            b = list(dict.fromkeys(b)) or [1]
        b = np.array(b, np.uint64)
        for least in (0.5, 0.8, 0.9):
            assert aligned(a, b, least) == (brute(a.tolist(), b.tolist()) >= least - 1e-9)


def test_all_links_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = classes(near_duplicates(docs))
    rows = docs.toArrow()
    ids = rows["doc_id"].to_pylist()
    w, at = word_hashes(rows["text"].combine_chunks())
    seqs = [labelled(shingles(w[at[i] : at[i + 1]])) for i in range(len(ids))]
    for i in range(len(ids)):
        for j in range(i):
            if min(len(seqs[i]), len(seqs[j])) >= 0.8 * max(len(seqs[i]), len(seqs[j])) and aligned(seqs[i], seqs[j], 0.8):
                assert got[ids[i]] == got[ids[j]]


def test_copies_of_an_original_in_the_middle(docs):
    """Independently edited copies are similar to their original alone, which is not the least id."""
    r = random.Random(8)
    base, rows = words(40, 300), []
    for i in range(240):
        text = list(base)
        for k in r.sample(range(300), 0 if i == 120 else 5):
            text[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(text)))
    w, at = word_hashes(docs(rows).toArrow()["text"].combine_chunks())
    seqs = [labelled(shingles(w[at[i] : at[i + 1]])) for i in range(len(rows))]
    root = list(range(len(rows)))  # classes by brute force over all pairs
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and aligned(seqs[i], seqs[j], 0.8):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert root.count(0) > 200
    assert classes(near_duplicates(docs(rows))) == dict(enumerate(root))


def test_cells_hold_all_pairs(spark):
    """Any two documents of a bucket that are in other groups meet, whatever the blocks; those of one large group do not."""
    root = {i: 0 if i < 50 else i // 3 * 3 for i in range(90)}
    shared = spark.createDataFrame([(i, k) for i in range(90) for k in (1, 2) if k == 1 or i % 2], "node bigint, k1 bigint")
    roots = spark.createDataFrame([(i, r) for i, r in root.items() if i != r], "node bigint, root bigint")
    for cell in (512, 20, 7):
        rows = cells(shared, roots, cell).collect()
        met: dict = {}
        for r in rows:
            met.setdefault(r.cell, []).append(r)
        pairs = {(min(x.node, y.node), max(x.node, y.node)) for c in met.values() for x in c for y in c if x.root != y.root and (x.side < 0 or x.side != y.side)}
        assert pairs == {(i, j) for j in range(90) for i in range(j) if root[i] != root[j]}
        assert max(map(len, met.values())) < 4 * cell + 10 and len([r for r in rows if r.node < 50]) <= 75 * -(-40 // cell)


def test_sketch_in_runs_and_windows():
    """Runs of shingles and windows of bytes change nothing; windows may cut long words."""
    h = np.random.default_rng(3).integers(0, 1 << 63, 999).astype(np.uint64)
    assert all((sketch(h, run=k) == sketch(h, run=4096)).all() for k in (1, 2, 7, 500))
    r, letters = random.Random(4), "aé z. Ü9"
    texts = ["".join(r.choice(letters) * r.choice((1, 1, 1, 9, 40)) for _ in range(r.randrange(60))) for _ in range(80)] + [None, "", "b" * 300]
    for pre in ((), (4, 5)):
        one, at = word_hashes(pa.array(texts), pre)
        for window in (16, 17, 40, 333):
            two, at2 = word_hashes(pa.array(texts), pre, window)
            assert (one == two).all() and (at == at2).all()
    assert [int(at[i + 1] - at[i]) for i in range(len(texts))] == [len(re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())) for t in texts]


def test_a_very_long_text_takes_bounded_memory():
    text = pa.array([" ".join(f"w{k % 9973}x{k % 7919}" for k in range(1_500_000))])
    size = len(text[0].as_py())
    tracemalloc.start()
    words_, _ = word_hashes(text)
    sketch(labelled(shingles(words_)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 15_000_000 and peak < 8 * size
