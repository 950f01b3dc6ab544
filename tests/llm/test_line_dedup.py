import random

import duckdb
import pytest
from conftest import words

from sitegauge.llm.line_dedup import alike, dedup_lines, line_facts, line_groups, occurrences


def test_line_dedup(docs):
    long = words(9, 120)
    near = " ".join([*long[:60], long[60] + "x", *long[61:]])
    rows = [(2, "Keep me first.\n" + " ".join(long) + "\n---\n"), (5, "keep ME first\n" + near.upper() + "\n---\nother unique line here"), (7, None), (8, ""), (9, "***"), (None, "null id line of some words\nkeep me first"), (11, "null id line of some words")]
    got = {r.doc_id: r for r in dedup_lines(docs(rows)).collect()}
    assert got[None].n_kept == 2 and got[2].text == " ".join(long) + "\n---\n" and got[2].n_lines == 4 and got[2].n_kept == 3
    assert got[5].text == "---\nother unique line here"
    assert got[7].text is None and got[7].n_lines == 0 and got[8].text == "" and got[9].text == "***" and got[11].text == ""
    assert dedup_lines(docs([])).collect() == []


def test_rows_that_share_an_id_keep_their_own_lines(docs):
    rows = [(1, "the same line of words\nzebra line"), (1, "quartz line\nthe same line of words"), (1, "quartz line\nthe same line of words"), (None, "first of all\nx y"), (None, "x y\nlast of all")]
    got = [r.text for r in dedup_lines(docs(rows)).collect()]
    kept = [line for t in got for line in t.split("\n")]
    assert {"zebra line", "quartz line", "first of all", "last of all"} <= set(kept) and kept.count("x y") == 1
    assert kept.count("the same line of words") in (1, 2)  # the two equal rows are treated alike


def edited(line, n, r):
    line = list(line)
    for _ in range(n):
        k, kind = r.randrange(len(line)), r.randrange(3)
        if kind == 0:
            line[k] = line[k][1:] + r.choice("aeiou")  # a typo
        elif kind == 1:
            line[k] = r.choice(words(r.randrange(9), 50))
        elif len(line) > 4:
            del line[k]
    return " ".join(line)


def groups(spark, docs, rows):
    lines = occurrences(docs(rows))
    keep = {(r.c1, r.c2): r.keep for r in line_groups(lines, line_facts(lines)).collect()}
    found = [(" ".join(r.words), r.c1, r.c2) for r in lines.collect()]
    return {norm: keep.get((c1, c2), norm) for norm, c1, c2 in found}


@pytest.mark.parametrize("size", [5, 8, 11, 20, 40, 150])
def test_recall_of_edited_lines(spark, docs, size):
    """Lines with one edit (two and three from 20 words on), against all pairs by Levenshtein, by length of the line."""
    r, rows = random.Random(size), []
    for n in range(150):
        line = words(1000 * size + n, size)
        rows += [(2 * n, " ".join(line)), (2 * n + 1, edited(line, 1 if size < 20 else 1 + n % 3, r))]
    got = groups(spark, docs, rows)
    norm = {i: t.strip() for i, t in rows}
    links, held = {}, {}
    for n in range(150):
        a, b, edits = norm[2 * n], norm[2 * n + 1], 1 if size < 20 else 1 + n % 3
        d = duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0]
        if a != b and 1 - d / max(len(a), len(b)) >= 0.8:
            links[edits] = links.get(edits, 0) + 1
            held[edits] = held.get(edits, 0) + (got[a] == got[b])
    assert sum(links.values()) > 20 and sum(held.values()) / sum(links.values()) >= 0.9, (held, links)
    # two blocks are always left by two edits; three edits of a short line may touch all six
    assert all(held[e] / links[e] >= (0.9 if e < 3 else 0.75) for e in links), (held, links)
    assert len(set(got.values())) >= 140  # unlike lines stay apart


def test_large_groups_lose_no_bucket_link(spark, docs):
    """Copies of a line with edits of their own: the original in the middle links them, whatever their number."""
    r, base = random.Random(2), words(3, 30)
    rows = [(i, " ".join(base) if i == 150 else edited(base, 2, r)) for i in range(300)]
    got = groups(spark, docs, rows)
    alike_ = [t for _, t in rows if 1 - duckdb.execute("SELECT levenshtein(?, ?)", [t, " ".join(base)]).fetchone()[0] / max(len(t), len(" ".join(base))) >= 0.8]
    assert len({got[t] for t in alike_}) == 1 and len(alike_) > 250


def test_distance_without_equal_ends(spark):
    r = random.Random(7)
    pairs = []
    for n in range(300):
        x = [r.choice(("ab", "abc", "b", "xyz", "q")) for _ in range(r.randrange(1, 12))]
        y = list(x) if n % 3 else [r.choice(("ab", "b", "q")) for _ in range(r.randrange(1, 12))]
        for _ in range(r.randrange(3)):
            y.insert(r.randrange(len(y) + 1), r.choice(("ab", "zz"))) if r.random() < 0.5 else y.pop(r.randrange(len(y))) if len(y) > 1 else None
        pairs.append((n, n, x, y))
    got = {p.a for p in alike(spark.createDataFrame(pairs, "a bigint, b bigint, x array<string>, y array<string>"), 0.8).collect()}
    want = {a for a, _, x, y in pairs if 1 - duckdb.execute("SELECT levenshtein(?, ?)", [" ".join(x), " ".join(y)]).fetchone()[0] / max(len(" ".join(x)), len(" ".join(y))) >= 0.8}
    assert got == want and 50 < len(want) < 290


def test_odd_rows(docs):
    rows = [(1, "word " * 30_000), (2, "word " * 30_000 + "\nlast"), (3, "\n" * 5000 + "a b c"), (4, None), (4, None), (5, "a b c\r\nd"), (6, "a b c")]
    got = sorted((r.doc_id, r.n_lines, r.n_kept) for r in dedup_lines(docs(rows)).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (3, 5001, 5001), (4, 0, 0), (4, 0, 0), (5, 2, 1), (6, 1, 0)]
    wide = docs(rows).withColumnRenamed("lang", "gone").withColumnRenamed("source", "copy")
    assert dedup_lines(wide).count() == 7


def test_long_lines_are_compared_in_words(spark):
    base = words(4, 100)
    pairs = [(k, k, base, [*base[:10], *words(5, k), *base[10 + k :]]) for k in (1, 15, 20, 21, 30)] + [(40, 40, base, base[25:])]
    assert {p.a for p in alike(spark.createDataFrame(pairs, "a bigint, b bigint, x array<string>, y array<string>"), 0.8).collect()} == {1, 15, 20}
