"""The pipeline's stages as a chain, on odd rows, against plain versions of each."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from conftest import words

import corpus_pipeline as cp
from sitegauge.llm import token_ids as ti

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, class_id int, root bigint"
ITEMS = [(k, " ".join(words(9000 + k, 40)) + ". " + " ".join(words(9500 + k, 12)) + ".") for k in range(6)]
BAD = ("scumbag", "idiotic", "vermin")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows, kind = random.Random(3), [], {}

    def add(i, text, source, what):
        rows.append((i, text, "en", source, len(text or ""), "x", 1, 2))
        kind.setdefault(i, what)

    for i in range(300):
        add(i, " ".join(words(i, 60 + i % 40)), ("a", "b", None)[i % 3], "clean")
    for i in range(300, 340):  # one or two words changed: near copies of an earlier document
        text = words(i - 300, 60 + (i - 300) % 40)
        text[r.randrange(60)] = "changed"
        add(i, " ".join(text), "a", "copy")
    for i in range(340, 350):
        add(i, " ".join(words(i - 300, 60 + (i - 300) % 40)), "b", "copy")
    for i in range(350, 362):
        add(i, " ".join(words(i, 50)) + " " + ITEMS[i % 6][1] + " " + " ".join(words(i + 1, 50)), "b", "leak")
    for i in range(400, 520):
        add(i, " ".join([*words(i, 30), BAD[i % 3], *words(i + 1, 30), BAD[(i + 1) % 3]]), "a", "toxic")
    add(600, None, None, "clean")
    add(601, "", "a", "clean")
    add(602, " \t\n", "a", "copy_of_601?")
    add(603, "one", "b", "clean")
    add(None, " ".join(words(700, 80)), "b", "clean")
    add(604, " ".join(words(701, 3000)), "a", "clean")
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(kind[i] == "toxic")) for i in kind if i is not None] + [(None, 1, 1), (12345, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*ITEMS, (None, None), (77, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, kind


def shingle_set(text):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_chain_against_plain_versions(spark, folder):
    path, rows, kind = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    made = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        made[name] = [(r.doc_id, r.text) for r in out.collect()]
        docs = spark.createDataFrame(out.collect(), docs.schema)
    texts = dict((r[0], r[1]) for r in rows)
    assert {i for i, _ in made["toxicity"]} == {i for i in texts if kind[i] != "toxic"}
    # all pairs by shared shingles; documents without words are grouped with equal texts only
    left = [i for i, _ in made["toxicity"] if i is not None]
    sets = {i: shingle_set(texts[i]) for i in left}
    gone = {i for i in left for j in left if j < i and (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or texts[i] is not None and texts[i] == texts[j])}
    assert {i for i, _ in made["near_duplicates"]} == {i for i, _ in made["toxicity"]} - gone and len(gone) > 40
    leaks = {i for i, t in made["near_duplicates"] if any(len(shingle_set(item) & shingle_set(t)) >= 0.8 * len(shingle_set(item)) for _, item in ITEMS)}
    assert {i for i, _ in made["decontamination"]} == {i for i, _ in made["near_duplicates"]} - leaks and leaks
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {r[0]: r[3] for r in rows}
    total, took = {}, {}
    for i, t in made["decontamination"]:
        total[source[i]] = total.get(source[i], 0) + size(t)
    for i, t in made["mixing"]:
        took[source[i]] = took.get(source[i], 0) + size(t)
    from sitegauge.llm.mixing import targets

    due = targets(list(total.items()))
    assert all(abs(took.get(s, 0) - due[s]) <= 2 * 3000 for s in due) and abs(took["b"] - due["b"]) <= 200


def test_run_gives_the_files_of_the_chain(spark, folder):
    path, _, _ = folder
    got = sorted(cp.run(spark, path).collect(), key=lambda r: r.start)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    encoder, at = ti.Encoder(ti.default_model()), 0
    for r in got:
        ids = [*encoder.whole([text[r.doc_id] or ""])[0].tolist(), ti.END_ID]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc)
        at += len(ids)
    assert len(got) > 250
    again = sorted(map(tuple, cp.run(spark, path).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


HELPERS = ("_size", "_id", "_ratio", "_n", "_source", "_psource", "_whole", "_copy", "_pid", "_psize", "_toxicity", "_items", "row", "items", "col", "n`o", "a", "b", "node", "_apart", "size")


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, folder, name):
    """The input has a column for each name that a stage uses inside; all come back as they were."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = docs.select("*", *[F.concat(F.lit(f"keep {h} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(h) for h in HELPERS])
    out = dict(cp.STAGES)[name](spark, plain, path)
    assert out.columns == plain.columns and out.schema == plain.schema
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[h] == f"keep {h} {r.doc_id if r.doc_id is not None else '-'}" for h in HELPERS)
    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None) == sorted((r.doc_id, r.text) for r in dict(cp.STAGES)[name](spark, docs, path).collect() if r.doc_id is not None and r.text is not None)
