"""Archives, neighbours, mixing, pages, the pipeline and the registry."""

import base64
import hashlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sitegauge.llm import warc
from sitegauge.llm.ann import balanced_parts, nearest, neighbour_graph
from sitegauge.llm.common import components
from sitegauge.llm.html_text import extract_pages, main_text
from sitegauge.llm.mixing import fly, land, mix, mix_plan, targets

PAGES = "page_id bigint, url string, html string, text string"


def sha(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (5, "http://c/", ""), (7, "u\r\nX: y", "ü" * 100_000), (None, "n", "same"), (9, "http://d", "only"), (3, "http://a/", "same")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], PAGES)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w")
    have = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got.collect())
    first = {"same": 1, "": 2, "ü" * 100_000: 7, "only": 9}
    want = []
    for i, _, h in rows:
        h = h or ""
        again = i != first[h]
        want.append((i or -1, len(h.encode()), sha(h.encode()), "revisit" if again else "response", first[h] if again else 0))
    assert have == sorted(want)
    full = {(r.page_id, bytes(r.payload)) for r in warc.resolve_revisits(got).collect()}
    assert full == {(i, (h or "").encode()) for i, _, h in rows}
    assert warc.archive(pages.limit(0)).collect() == []


def test_archives_are_plain_zstd_and_checked():
    dictionary = zstandard.ZstdCompressionDict(b"WARC/1.1 response text/html " * 30)
    raw = warc.record(4, "http://x/", b"payload", None, False)
    frame = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True).compress(raw)
    content = warc.dictionary_frame(dictionary.as_bytes()) + frame + warc.SEPARATOR.encode() + frame
    assert list(warc.frames(content)) == [raw, raw]
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary.as_bytes())) + frame
    assert list(warc.frames(packed)) == [raw]
    assert warc.parse(raw)["body"] == b"payload"
    for broken in (content[:-5], content[:-12] + bytes([content[-12] ^ 255]) + content[-11:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            [warc.parse(r) for r in warc.frames(broken)]
    for bad in (raw.replace(b"Content-Length: 7", b"Content-Length: 6"), raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"payload", b"paYload"), b"WARC/9" + raw[8:]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 3, 1), (None, x[0].tolist(), 1), (950, [*x[0][:15].tolist(), None], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == [1, 2, 3, 4, 5]
        for v, score in found.values():
            assert abs(score - s[v]) < 1e-12
    assert hits / (5 * len(got)) >= 0.9
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    assert nearest(table.limit(0), F.lit(True)).collect() == []
    two = nearest(table.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(two) == 2


def test_many_parts_keep_the_recall(spark):
    """Routing over 32 parts, with queries that share an id."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))[rng.integers(0, 60, 6000)] + 0.7 * rng.normal(size=(6000, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[0].tolist())], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest(table, F.col("vec_id") % 50 == 0, parts=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist())) if q != 50 else 5
    assert len(got) == 120 and hits / 600 >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(balanced_parts(x, neighbour_graph(x, 8), 8), minlength=8)
    assert sizes.max() <= 111 and sizes.sum() == 800


def test_targets():
    assert targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": 250 / 3, None: 500 / 3}
    assert targets([("b", 10), ("a", 0)]) == {"a": 0.0, "b": 15.0}
    assert targets([]) == {}


def test_cube_keeps_the_totals():
    rng = np.random.default_rng(4)
    p, size = rng.random(500), rng.integers(1, 900, 500)
    x = fly(p, size, 3)
    open_ = ((x > 1e-9) & (x < 1 - 1e-9)).sum()
    assert open_ <= 2 and abs(x.sum() - p.sum()) < 1e-6 and abs((x * size).sum() - (p * size).sum()) < 1e-3
    y = land(x, size)
    assert set(np.round(y, 9)) <= {0.0, 1.0} and abs((y * size).sum() - (p * size).sum()) <= 2 * size.max()
    mean = np.mean([land(fly(p, size, s), size) for s in range(300)], axis=0)
    assert abs(mean - p).mean() < 0.04  # chances are kept


def test_mixing(docs):
    rows = [(i, "w " * (1 + i % 37), "en", "big" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(5000, None, None, None), (5001, " \t\n", "en", "big"), (5002, "a b", "en", None), (7, "w " * 8, "en", "big")]
    plan = mix_plan(docs(rows), block=200)
    a = sorted(map(tuple, plan.collect()), key=str)
    assert a == sorted(map(tuple, mix_plan(docs(rows), block=200).collect()), key=str) and len(a) == len(rows)
    per = {}
    for doc, size, source_size, target, taken, source in a:
        assert taken in (0, size, 2 * size)
        t = per.setdefault(source, [0, target, source_size, 0])
        t[0] += taken
        t[3] += size
    for source, (taken, target, size, total) in per.items():
        assert size == total and abs(taken - target) <= 2 * 37
    assert sum(t[1] for t in per.values()) == pytest.approx(1.5 * sum(t[2] for t in per.values()))
    copies = docs([(1, "w w w", "en", "a")] * 900 + [(k, "w " * (k % 9 + 1), "en", "b") for k in range(900)])
    dealt = mix_plan(copies, block=100).filter("source = 'a'").collect()
    assert len(dealt) == 900 and abs(sum(r.taken for r in dealt) - dealt[0].target) <= 6
    out = mix(docs(rows), block=200)
    assert out.columns == docs(rows).columns
    assert mix_plan(docs([])).collect() == [] and mix(docs([])).collect() == []


PAGE = """<html><head><title>T</title><style>x</style></head><body><header>Site head</header><nav><a href=/a>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>The &amp; title</h1><p>First  <b>bold</b>
text &lt;here&gt;.<p>Second one<br>goes on.</p><script>var a="<p>no</p>";</script><aside>Side note</aside><div id="comments"><p>reader comment text</p></div></article>
<form><p>Sign up</p></form><footer>&copy; foot</footer></body></html>"""
LOOSE = "<div id=menu><a href=1>One</a> <a href=2>Two</a></div><h2>Short heading</h2><p>{0}</p><p>Tiny.</p><p>{0}</p><div class=sidebar>{0}</div><p><a href=x>only a link here</a></p>".format("this is the long text of the page and it has a good number of the words that we know in it, so that it is what the rules take " * 3)


def test_main_text(spark):
    assert main_text(PAGE) == "The & title\n\nFirst bold text <here>.\n\nSecond one goes on."
    blocks = main_text(LOOSE).split("\n\n")
    assert blocks[0] == "Short heading" and blocks[2] == "Tiny." and len(blocks) == 4
    assert main_text(None) == main_text("") == main_text("<!-- x --><script>y") == ""
    assert main_text("just text") == "just text" and main_text("<p>a < b and c</p>") == "a < b and c"
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], PAGES)
    got = extract_pages(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, len(main_text(PAGE)), len(main_text(PAGE))] and got[0].text == main_text(PAGE)
    assert extract_pages(rows.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[200] == 100 and 300 not in got and all(got[1000 + k] == 1000 for k in range(50))


def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline as cp
    from sitegauge.llm.near_dup import near_duplicates

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for (name, stage), n in zip(cp.STAGES[:-1], range(4)):
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.toPandas(), docs.schema)
        if name == "near_duplicates":
            assert near_duplicates(seen).filter("class_id <> doc_id").count() == 0
    rows = cp.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in seen.select("doc_id").collect())


def test_registry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
