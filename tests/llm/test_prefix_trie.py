import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from refrain.llm import prefix_trie as pt
from refrain.llm.prefix_trie import ordered_turns, prefix_trie, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string, idx string, last string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "k", "i", "l") for r in rows], SCHEMA)


def built(spark, rows):
    df = prefix_trie(*with_shared_openings(ordered_turns(table(spark, rows))))
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in paths.items():
        ends[tuple(p)].append(c)
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(of), len(n), min(members[n[:-1]]) if n else None, len(of), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, of in members.items()
    )


def conversations(seed, n, longest, variety=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if variety > 1 else "user", f"é{rng.randrange(variety)}") for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("band,block", [(2, 4096), (3, 6), (16, 4096)])
def test_equals_brute_force(spark, monkeypatch, band, block):
    monkeypatch.setattr(pt, "BAND", band)
    monkeypatch.setattr(pt, "BLOCK_ROWS", block)
    rows = conversations(1, 80, 40, 1)
    rows += [(300 + c, t, "user", "é0") for c in range(30) for t in range(25)]  # many copies
    rows += [(500, t, "user", f"long{t % 7}") for t in range(150)] + [(501, t, "user", f"long{t % 7}") for t in range(100)]
    random.Random(2).shuffle(rows)
    assert built(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(pt, "PACK", 3)
    rows = conversations(3, 60, 6, 3)
    rows += [(None, 0, "user", "x"), (70, None, None, None), (70, 0, "user", "b"), (70, 0, "user", "a"), (70, 0, "user", "a"), (71, None, "", ""), (72, 5, "user", "y" * 50_000)]
    rows += [(-3, 0, "user", "é0"), (-5, 0, "user", "é1"), (2**40, 1, "user", "z"), (73, -1, "ab", "c"), (74, -1, "a", "bc")]
    rows += [(80 + c, 0, "user", "same") for c in range(40)]
    assert built(spark, rows) == brute(rows)


def test_empty(spark):
    assert built(spark, []) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    turns = ordered_turns(table(spark, [(1, 0, "user", "hi")]))
    got = {tuple(r) for r in prefix_trie(turns, spark.createDataFrame([(1,), (7,)], "conv_id long")).select("conv_id", "depth", "n_convs", "n_leaves").collect()}
    assert got == {(1, 0, 2, 1), (1, 1, 1, 1)}
