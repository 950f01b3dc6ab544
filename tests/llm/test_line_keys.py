import random

import duckdb
import pytest
from conftest import words
from pyspark.sql import functions as F
from test_line_dedup import edited, groups

from sitegauge.llm.line_dedup import dedup_lines, line_facts, occurrences, shared_buckets


def test_near_lines_meet_in_few_buckets(spark, docs):
    """A group of near lines is met once for each equal block, not once for each pair of them."""
    r, base = random.Random(3), words(9, 40)
    rows = [(i, edited(base, 1, r)) for i in range(120)]
    facts = line_facts(occurrences(docs(rows))).withColumn("node", F.monotonically_increasing_id())
    shared = shared_buckets(facts).groupBy("node").count().collect()
    assert len(shared) == 120 and max(n["count"] for n in shared) <= 6


@pytest.mark.parametrize("size", [20, 26, 60])
def test_recall_of_three_edits(spark, docs, size):
    r, rows = random.Random(size), []
    for n in range(150):
        line = words(1000 * size + n, size)
        rows += [(2 * n, " ".join(line)), (2 * n + 1, edited(line, 3, r))]
    got, norm = groups(spark, docs, rows), {i: t.strip() for i, t in rows}
    near = [(a, b) for a, b in ((norm[2 * n], norm[2 * n + 1]) for n in range(150)) if a != b and 1 - duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] / max(len(a), len(b)) >= 0.8]
    assert len(near) > 40 and sum(got[a] == got[b] for a, b in near) / len(near) >= 0.9


@pytest.mark.parametrize("size", [7, 8, 12, 13, 17, 18, 22, 23])
def test_lines_at_the_edge_of_two_kinds_of_keys_meet(spark, docs, size):
    """A word more or less must not take a line to keys that its partner lacks."""
    rows = []
    for n in range(60):
        line = words(500 * size + n, size + 1)
        rows += [(2 * n, " ".join(line)), (2 * n + 1, " ".join(line[:4] + line[5:]))]
    got = groups(spark, docs, rows)
    near = [(a, b) for a, b in ((rows[2 * n][1], rows[2 * n + 1][1]) for n in range(60)) if 1 - duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] / max(len(a), len(b)) >= 0.8]
    assert len(near) > 20 and sum(got[a] == got[b] for a, b in near) / len(near) >= 0.9


def test_lines_that_only_case_and_signs_tell_apart(docs):
    rows = [(1, "ÄRGER über Straßen\nÉté 2024"), (2, "ärger, ÜBER; straßen!\n— … —\nété-2024"), (3, "»« \n\t\nK")]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "— … —", 3: rows[2][1]}


def test_texts_are_hashed_once_and_words_are_in_no_row(spark, docs):
    """The hash of a text is made below the cut into lines, and facts are made of lines without an array of their words."""
    plan = line_facts(occurrences(docs([(1, "some line\nother line")])))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("posexplode(") < plan.index("xxhash64(text#") and "AS words#" not in plan


def test_groups_are_joined_by_their_roots_alone(spark, monkeypatch):
    """Links between groups must not send all nodes through the rounds again."""
    from sitegauge.llm import line_dedup

    seen, real = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda edges: seen.append(edges.count()) or real(edges))
    roots = spark.createDataFrame([(n, n - n % 10) for n in range(100)], "node bigint, root bigint")
    links = spark.createDataFrame([(13, 27), (29, 44), (200, 91), (300, 301), (55, 58)], "a bigint, b bigint")
    got = {r.node: r.root for r in line_dedup.regrouped(roots, links).collect()}
    want = {n: 10 if 10 <= n < 50 and n // 10 != 3 else n - n % 10 for n in range(100)} | {200: 90, 300: 300, 301: 300}
    assert got == want and seen == [5]
