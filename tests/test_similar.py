"""Similarity joins against all pairs, with terms that every title has and many copies."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import similar, texts

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()


def sides(seed, n, everywhere=("zulu",)):
    r = random.Random(seed)
    return [{k: {w: r.randint(1, 3) for w in (*everywhere, *r.sample(WORDS, r.randint(0, 4)))} for k in range(n)} for _ in "ab"]


def frames(spark, both):
    return [spark.createDataFrame([(k, w, n) for k, v in s.items() for w, n in v.items()], f"{name} int, term string, w int") for name, s in zip("ab", both)]


def cosine(x, y):
    norm = lambda v: math.sqrt(sum(n * n for n in v.values()))
    return sum(n * y.get(w, 0) for w, n in x.items()) / (norm(x) * norm(y))


@pytest.mark.parametrize("least", [1e-9, 0.3, 0.6, 0.95])
def test_pairs_with_a_term_in_every_title(spark, monkeypatch, least):
    """Cells of seven rows: the common term is dealt to many, each pair still comes once."""
    monkeypatch.setattr(similar, "CELL", 7)
    both = sides(3, 60)
    want = {(a, b): c for a, b in itertools.product(*both) if (c := cosine(both[0][a], both[1][b])) >= least}
    got = [(r.a, r.b, r.score) for r in similar.cosine_pairs(*frames(spark, both), least).collect()]
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == set(want)
    assert all(abs(s - want[a, b]) < 1e-9 for a, b, s in got)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_in_two_steps(spark, monkeypatch, k):
    monkeypatch.setattr(similar, "CELL", 5)
    both = sides(5, 40, ())
    both[1] |= {k: dict(both[1][0]) for k in range(100, 130)}  # copies
    both = [{k: v for k, v in s.items() if v} for s in both]
    got = {}
    for r in similar.nearest(*similar.index(*frames(spark, both)), k, 1e-9).collect():
        got.setdefault(r.a, []).append((-r.score, r.b))
    for a, x in both[0].items():
        scored = sorted((-round(c, 4), b) for b, y in both[1].items() if (c := cosine(x, y)) >= 1e-9)[:k]
        assert sorted(got.get(a, [])) == scored


def test_copies_make_no_pairs_of_their_own(spark):
    """Two thousand equal titles on either side are one pair of classes."""
    left, right = (spark.range(2000).select(F.col("id").alias(k), F.lit("same old title").alias("title")) for k in "ab")
    got = texts.near_duplicate_topics(left, right).collect()
    assert len(got) == 2000 and {(r.b, r.score, r.matches) for r in got} == {(0, 1.0, 2000)}
    one, two = similar.index(*(texts.text_terms(t, "title", k).withColumnRenamed("n", "w") for t, k in ((left, "a"), (right, "b"))))
    assert similar.similar(one, two, 0.6).count() == 1


def test_common_terms_are_not_looked_up_where_the_rest_decides(spark):
    """A term of all titles stands last in every vector and is no posting of those that have enough without it."""
    both = sides(7, 50)
    one, _ = similar.index(*frames(spark, both))
    common = spark.sql("SELECT xxhash64('zulu') AS id")
    asked = similar._postings(similar._classes(one), 0.95).join(common, "id").select("cls").distinct().count()
    assert asked < one.select("cls").distinct().count() / 2
    plan = similar.similar(one, one, 0.6)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_terms(spark):
    empty = spark.createDataFrame([], "a int, title string")
    other = spark.createDataFrame([(1, "the of"), (2, "some title"), (3, None)], "b int, title string")
    assert texts.near_duplicate_topics(empty, other).collect() == []
    got = texts.best_match(other.withColumnRenamed("b", "a"), other).collect()
    assert {(r.a, r.b) for r in got} == {(1, None), (2, 2), (3, None)}


def test_only_rows_without_a_good_match_go_on(spark, monkeypatch):
    """Best matches of 0.71, 0.41, 0.25 and 0.14: each step takes one row out."""
    left = spark.createDataFrame([(k, f"own{k}", 1) for k in range(4)], "a int, term string, w int")
    right = spark.createDataFrame([(k, w, 1) for k, n in enumerate((2, 6, 16, 50)) for w in (f"own{k}", *(f"w{k}x{i}" for i in range(n - 1)))], "b int, term string, w int")
    seen, real = {}, similar.similar
    monkeypatch.setattr(similar, "similar", lambda one, two, least: seen.update({round(least, 2): one.select("cls").distinct().count()}) or real(one, two, least))
    got = {r.a: (r.b, r.score) for r in similar.nearest(*similar.index(left, right), 1, 0.08).collect()}
    assert got == {0: (0, 0.7071), 1: (1, 0.4082), 2: (2, 0.25), 3: (3, 0.1414)}
    assert seen == {0.7: 4, 0.5: 3, 0.35: 3, 0.2: 2, 0.08: 1}


@pytest.mark.parametrize("least", [0.1, 0.35, 0.7])
def test_long_vectors_share_bits(spark, least):
    """Vectors of up to 150 terms have several terms to a bit; copies with a few terms changed reach any threshold."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    both = [{k: {w: r.randint(1, 3) if k % 2 else 2 for w in r.sample(words, r.randint(1, 150))} for k in range(20)} for _ in "ab"]
    both[1] |= {100 + k: dict(list(v.items())[: max(1, len(v) * 2 // 3)]) for k, v in both[0].items()}
    want = {(a, b): c for a, b in itertools.product(*both) if (c := cosine(both[0][a], both[1][b])) >= least}
    got = {(x.a, x.b): x.score for x in similar.cosine_pairs(*frames(spark, both), least).collect()}
    assert set(got) == set(want) and all(abs(s - want[p]) < 1e-9 for p, s in got.items()) and len(want) >= 15
