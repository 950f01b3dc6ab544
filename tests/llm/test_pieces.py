"""Ids by distinct chunks against the library's of the whole text."""

import hashlib

import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm.pieces import _model, chunks, decode, digests, encode
from sitegauge.llm.token_counts import default_model

DOCS = "doc_id bigint, text string, ids int, run string, words int"


def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def compare(docs, **options):
    sp = library()
    got = sorted(((r.doc_id, r.ids, r.text) for r in decode(encode(docs.select("doc_id", "text"), **options)).collect()), key=str)
    rows = [(r.doc_id, sp.encode(r.text or "")) for r in docs.collect()]
    assert got == sorted([(i, ids, sp.decode(ids) if ids else "") for i, ids in rows], key=str)
    return got


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "a\nb c\n d", "▁", "a▁ b", "a ▁b ▁ c", "▁▁ a", "\t a b ", "日本語 テキスト 😀😀 é é", "<s> </s> <unk> <0x41>", "\x00 a", "x" * 3000, "ab " * 2000, " ".join(f"w{i}" for i in range(3000))]


def test_odd_texts(spark):
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(ODD)] * 2 + [(None, "no id", 1, "clash", 2)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for run in (1, 5000, 1 << 24):
        assert len(compare(docs, run_bytes=run)) == len(rows)
    assert decode(encode(docs.limit(0))).collect() == []
    assert decode(encode(docs.filter("text is null"))).collect()[0].text == ""


def test_whole_table_and_digests(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sp = library()
    want = {}
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids) if ids else ""))
    assert {r.doc_id: tuple(r)[1:] for r in digests(decode(encode(docs))).collect()} == want


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab .\n▁é日\t") | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_chunks_encode_as_their_text(text):
    sp, cut = _model(default_model())
    assert cut
    parts = chunks(pa.array([text]))[0].to_pylist()[0]
    assert [i for p in parts for i in sp.encode(p)] == sp.encode(text)


def test_texts_that_may_not_be_cut_stay_whole(spark, monkeypatch, tmp_path):
    """A model whose normalizer squeezes spaces gives its own ids still."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(default_model(), "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "other.model")
    open(path, "wb").write(model.SerializeToString())
    assert not _model(path)[1]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "a  b "), (2, None), (3, " c")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode(docs, path).collect()} == {1: sp.encode("a  b "), 2: [], 3: sp.encode(" c")}
