"""The prefix trie against one built turn by turn."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from sitegauge.llm import trie
from sitegauge.llm.trie import conversation_turns, prefix_trie, rebuilt

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, depth int, a string, len int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, graft=True):
    own = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    if not own:
        return []
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:]) if graft else tuple(turns)
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if made[c] == node)
        up = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), up, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def compare(conversations):
    got = prefix_trie(*rebuilt(*conversation_turns(conversations)))
    assert got.columns == COLUMNS
    got = sorted(map(tuple, got.collect()), key=lambda r: r[:2])
    assert got == plain([r.asDict() for r in conversations.collect()])
    return got


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], CONVERSATIONS)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "", "u"), (2, 1, "u", "b a"), (2, 1, "u", "b a"), (2, None, "s", "x" * 100_000), (None, 1, "u", "lost"), (20, 5, "u", "head one"), (20, 6, "a", "head two")]
    rows += [(c, t, "u", f"t{t} {c % 3 * (t > 2)}") for c in range(21, 60) for t in range(c % 6)] + [(c, 0, "u", "only") for c in range(100, 140)]
    got = compare(make(spark, rows).repartition(3))
    assert any(n[3] > 1 and n[1] > 1 for n in got)


def test_no_rows(spark):
    assert compare(make(spark, [])) == []
    assert compare(make(spark, [(None, 1, "u", "t")])) == []


def test_long_conversations_over_several_bands_and_runs(spark, monkeypatch):
    """One conversation holds most rows; with short runs and low bands it takes several of each."""
    monkeypatch.setattr(trie, "RUN", 8)
    monkeypatch.setattr(trie, "HEIGHT", 2)
    rows = [(c, t, "u", f"w {t} {int(t > 30 and c % 2)}") for c in (40, 41, 47, 60) for t in range(75)] + [(c, t, "u", f"w {t} 0") for c in (42, 80) for t in range(8)]
    compare(make(spark, rows))


def test_copies_of_a_conversation_share_one_end(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 64)
    rows = [(c, t, "u", f"same {t}") for c in range(0, 6000, 20) for t in range(2)]
    got = compare(make(spark, rows))
    assert [n[3] for n in got] == [300, 300, 300]


@pytest.mark.parametrize("graft", [True, False])
def test_whole_table(spark, sf, graft):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    turns, convs = conversation_turns(conversations)
    got = prefix_trie(*rebuilt(turns, convs)) if graft else prefix_trie(turns, convs)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain([r.asDict() for r in conversations.collect()], graft)
