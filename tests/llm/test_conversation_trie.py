"""The prefix trie against a trie built turn by turn."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roughcut.llm.common import numbered, stored
from roughcut.llm.conversation_trie import ordered_turns, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string, total string, block long, n long"


def trie(df):
    turns = stored(ordered_turns(df), "t")
    c = F.col("conv_id")
    convs, again = rebuilt(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5, 8)
    return prefix_trie(convs, stored(again, "rebuilt"))


def brute(rows):
    original = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            original[r.conv_id].append((r.turn is not None, r.turn or 0, digest, role, text))
    whole = {}
    for c in original:
        original[c].sort()
    for c in list(original):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = tuple(x[3:] for x in original.get(base, [])[:h] + original[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[:d - 1]].add(seq[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations(spark):
    rnd = random.Random(3)
    rows = []
    for c in [*range(-7, 40), None]:
        for t in range(rnd.choice([0, 1, 2, 5, 9, 20])):
            text = rnd.choice(["x", "y", "é", None, ""]) if rnd.random() < 0.9 else "long" * 5
            rows.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["u", "a", None]), text))
    # long copies, one longer by a few turns, and repeated rows of one turn
    rows += [(c, t, "u", "same") for c, n in ((100, 30), (101, 30), (103, 33)) for t in range(n)]
    rows += [(102, 0, "q", "r")] * 5 + [(10**12, 0, "u", "same"), (-10**12, 3, None, None)]
    return spark.createDataFrame([(*r, 1, "k", "t", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_equals_brute_force(conversations, parts):
    got = sorted((tuple(r) for r in trie(conversations.repartition(parts)).collect()), key=str)
    assert got == brute(conversations.collect())


def test_small_blocks_and_groups_give_the_same_trie(spark, conversations, monkeypatch):
    from roughcut.llm import conversation_trie as module
    monkeypatch.setattr(module, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(module, "ID_RANGE", 3)
    turns = stored(ordered_turns(conversations), "t")
    c = F.col("conv_id")
    convs, again = rebuilt(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5, 8)
    got = prefix_trie(convs, stored(again, "rebuilt"), block_turns=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(conversations.collect())


def test_turnless_conversations_are_members_of_the_root(spark):
    """Conversation 6 has one turn and borrows none from an absent conversation 5."""
    h6 = zlib.crc32(b"6") % 9
    assert h6 > 0
    df = spark.createDataFrame([(6, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    rows = trie(df).collect()
    assert [tuple(r)[:7] for r in rows] == [(6, 0, None, 1, 0, 1, 0)]
    assert rows[0].ends_sha256 == hashlib.sha256(b"6").hexdigest()


def test_empty_table(conversations):
    assert trie(conversations.where("false")).collect() == []
    assert trie(conversations.where("conv_id IS NULL")).collect() == []


def test_numbers_of_a_hot_group_come_from_many_parts(spark):
    """A third of the rows in one group, many of them equal: numbers without gaps, no group in one task."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("g"),
                                  F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("o"))
    out = numbered(df.repartition(9), ["g"], ["o"], "nr", "numbered")
    rows = sorted((r.g, r.nr, r.o) for r in out.collect())
    hot = [(nr, o) for g, nr, o in rows if g == 7]
    assert [nr for nr, _ in hot] == list(range(len(hot))) and [o for _, o in hot] == sorted(o for _, o in hot)
    assert all(nr == 0 for g, nr, _ in rows if g != 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 2 and "RangePartitioning" not in plan
