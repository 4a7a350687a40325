"""The prefix trie against a dictionary of prefixes, and its list ranking against a walk."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from threadloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, nid long, depth int, slice string, key int, i int, h string, chars int"


def brute_trie(rows, share=100, most=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest(), text))
    for v in turns.values():
        v.sort()
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(math.fmod(c, share))
        seq = tuple((r, t) for *_, r, _, t in turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for e in range(len(p) + 1):
            leaves[p[:e]] += not children[p]
            saved[p[:e]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *tuple(r)[3:]) for r in df.collect())


@pytest.mark.parametrize("every,few", [(3, 4), (32, 10), (2, 1)])
def test_list_ranking(spark, every, few):
    rng = random.Random(every)
    ids = rng.sample(range(10**6), 230)
    lists = [ids[:200], ids[200:229], ids[229:]]
    arcs = [(a, b) for x in lists for a, b in zip(x, x[1:] + [None])]
    got = prefix_trie.list_rank(spark.createDataFrame(arcs, "id long, next long"), every, few).collect()
    assert sorted(tuple(r) for r in got) == sorted((a, len(x) - 1 - i) for x in lists for i, a in enumerate(x))


ODD = [
    (100, 1, "user", "a"), (100, 2, "user", "b"), (100, 3, None, None), (100, None, "user", "first"), (101, 0, "x", "own"), (101, 0, "x", "own"), (102, 0, "x", "own"),
    (None, 1, "user", "lost"), (7, 1, "", ""), (8, 1, None, ""), (9, None, "user", "é" * 40000), (9, None, "user", "z"), (250, 3, "a", "long"), (200, 1, "a", "only"), (201, 1, "a", "b"), (201, 1, "b", "a"), (-5, 1, "q", "neg"), (0, 1, "q", "zero"),
]


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1], [(c, t, "u", "same") for c in range(120) for t in range(5)], [(c, t, "u", f"{t}") for c, n in ((0, 200), (1, 199), (2, 2)) for t in range(n)]])
def test_odd_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 30)
    df = spark.createDataFrame([(*r, 1, 2, "s", 3, 4, "h", 5) for r in rows], SCHEMA)
    assert nodes(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_random_tries(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", None]), rng.choice(["a", "b", ""])) for c in rng.sample(range(400), 120) for t in range(rng.randrange(7))]
    monkeypatch.setattr(prefix_trie.list_rank, "__defaults__", (4, 8))
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute_trie(rows)


def test_op13_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op13_prefix_trie(spark, sf)) == brute_trie(rows)
