"""The manifest against a plain tree, on odd rows and on a whole table."""

import hashlib
import zlib

import pytest

from sitegauge.llm.merkle import backward, document_manifest, forward, manifest, verified

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, row int, path int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            a = i // 8 * 8
            proof.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
            i //= 8
        proofs.append(proof)
    return levels[-1][0], proofs


def plain(rows):
    def leaf(r, small=False):
        text = r["text"]
        if small and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    subroots, proved = {}, []
    for lang, members in groups.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroots[lang], proofs = tree([leaf(r) for r in members])
        proved += zip(members, proofs)
    names = sorted(subroots, key=lambda k: (k is not None, (k or "").encode()))
    root, above = tree([subroots[k] for k in names]) if names else ("", [])
    above = dict(zip(names, above))
    out = []
    for r, proof in proved:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        path, digest = proof + above[r["lang"]], leaf(r, tampered)
        for left, right in path:
            digest = H(left, digest, right)
        out.append((r["doc_id"], leaf(r), subroots[r["lang"]], root, H(*[a + b for a, b in path]), digest, digest == root))
    return sorted(out, key=str)


def compare(docs):
    got = verified(document_manifest(docs)).collect()
    assert sorted(map(tuple, got), key=str) == plain([r.asDict() for r in docs.collect()])
    return got


ODD = [(1, "a", None, 1, None), (2, None, "x", None, "AbC"), (None, "s", "x", 2, "A"), (3, "é", "", 2, ""), (4, "ß", "é", 2, "Ä" * 50_000)]


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    assert len(compare(make(spark, ODD[:n]))) == n


def test_odd_rows_equal_rows_and_many_groups(spark):
    equal = [(7, "s", "same", 3, "ABC")] * 700
    large = [(i, "s", "large", i, f"T{i % 7}") for i in range(4200)]
    small = [(i, "s", f"l{i}", i, "T") for i in range(70)]
    got = compare(make(spark, ODD * 3 + equal + large + small).repartition(5))
    assert {r.verified for r in got} == {True, False}


def test_whole_table(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 511, 512])
def test_sweeps_of_a_block(n):
    """Forward and backward give the tree's digests and proofs."""
    leaves = [H(str(i)) for i in range(n)]
    levels = next(k for k in range(4) if 8**k >= n)
    nodes = forward(leaves, levels)
    times = [(min((i + 1) * 8**level, n), level) for level, i, _ in nodes]
    assert times == sorted(times)
    root, proofs = tree(leaves)
    assert (H(*nodes[-1][2]) if nodes else leaves[0]) == root
    got = backward(nodes, n, [{"left": "l", "right": "r"}])
    assert [[(s["left"], s["right"]) for s in p] for p in got] == [[*p, ("l", "r")] for p in proofs]


def test_further_columns_come_back(spark):
    rows = spark.createDataFrame([("g", i, H(str(i)), i, {"k": i}) for i in range(20)], "g string, i int, d string, b int, row map<string,int>")
    got = {r.i: (r.g, r.d, r.b, r.row) for r in manifest(rows, "g", "i", "d").collect()}
    assert got == {i: ("g", H(str(i)), i, {"k": i}) for i in range(20)}
