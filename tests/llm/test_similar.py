"""Near-duplicates by exact Jaccard, and the roots they are grouped by, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import near_duplicates


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_kept(texts, least=0.8):
    """Ids of the smallest of each component, and the similarities of the linked pairs."""
    sets, root, linked = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, {}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (v := jaccard(sets[i], sets[j])) >= least:
                linked[i, j] = v
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return set(root.values()), linked


def near_copies(seed=11):
    """Texts of 60 to 200 words with copies of 1 to 6 edits, a chain of such, a crowd about one text, and unlike texts with a common passage."""
    g = np.random.default_rng(seed)
    words = ["".join(chr(97 + int(c)) for c in g.integers(0, 26, 5)) for _ in range(500)]
    prose = lambda n: [str(x) for x in g.choice(words, n)]

    def edited(w, edits):
        w = list(w)
        for i in g.integers(0, len(w), edits):
            w[i] = str(g.choice(words))
        return w

    out = []
    for _ in range(25):
        base = prose(int(g.integers(60, 200)))
        out += [base, *(edited(base, e) for e in range(1, 7))]
    step = prose(150)
    for _ in range(8):
        out.append(step)
        step = edited(step, 2)
    hot = prose(100)
    out += [edited(hot, int(e)) for e in g.integers(1, 6, 60)]
    passage = prose(30)
    out += [prose(40) + passage + prose(40) for _ in range(60)]
    return {i: " ".join(out[int(k)]) for i, k in enumerate(g.permutation(len(out)))}


@pytest.fixture(scope="module")
def copies():
    texts = near_copies()
    return texts, *brute_kept(texts)


def test_stage_finds_all_near_copies(spark, copies):
    texts, want, linked = copies
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sum(0.8 <= v < 0.9 for v in linked.values()) > 100
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, "").collect()}
    assert kept == want


def test_stage_links_by_fingerprints_first(spark, copies, monkeypatch):
    """Every pair of fingerprints within two bits whose texts are alike is linked by the SimHash step, and the stage takes it."""
    texts, want, linked = copies
    make = near_duplicates.fingerprint_maker(5)()
    ids = sorted(texts)
    fp = dict(zip(ids, make([texts[i] for i in ids])["fp"], strict=True))
    near = {(a, b) for a, b in linked if ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 2}
    assert near
    nodes = near_duplicates._set_maker(5)()([texts[i] for i in ids])["node"]
    node = {i: int(n) for i, n in zip(ids, nodes, strict=True)}
    points = spark.createDataFrame(sorted({node[i]: fp[i] for i in ids}.items()), "node long, fp long")
    got = {(r["a"], r["b"]) for r in near_duplicates.simhash_pairs(points).collect()}
    assert {tuple(sorted((node[a], node[b]))) for a, b in near if node[a] != node[b] and fp[a] != fp[b]} <= got
    seen, real = [], near_duplicates.simhash_pairs
    monkeypatch.setattr(near_duplicates, "simhash_pairs", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, "").collect()} == want
    assert len(seen) == 1


@pytest.mark.parametrize("crowd, hubs", [(2, 1), (8, 2)])
def test_crowded_groups_lose_nothing(spark, copies, crowd, hubs):
    texts, want, _ = copies
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in near_duplicates.drop_similar(df, crowd=crowd, hubs=hubs).collect()} == want


def test_components_that_share_an_id_stay_apart(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    df = spark.createDataFrame([(5, a), (7, a), (5, b), (9, b), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    for drop in (near_duplicates.drop_near_duplicates, near_duplicates.drop_similar):
        assert sorted(tuple(r) for r in drop(df).filter("doc_id IS NOT NULL").collect()) == [(5, a), (5, b)]
        assert drop(df).count() == 3


def test_parity_maps_turn_no_similar_pair_away(spark):
    """Sets of all sizes, about the widths' borders too: what has the similarity passes, and most of what has not does not."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    g = np.random.default_rng(3)
    least, rows, truth = Fraction(4, 5), [], []
    wide = lambda n: 8 * 4 ** sum(n > 1000 * 4**i for i in range(4))
    for n in (1, 2, 5, 30, 300, 900, 1000, 1001, 1200, 3900, 4100, 9000):
        for keep in (1.0, 0.95, 0.9, 0.89, 0.885, 0.8, 0.5, 0.0):
            a = g.integers(-(2**63), 2**63 - 1, n)
            b = np.concatenate([a[: int(n * keep)], g.integers(-(2**63), 2**63 - 1, n - int(n * keep))])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            truth.append(5 * both >= 4 * (len(a) + len(b) - both))
            side = lambda s: (len(s), near_duplicates.parity_map(s, wide(len(s))).tolist())
            rows.append((len(truth) - 1, side(a), side(b)))
            rows.append((len(truth) - 1, side(a), (len(b), near_duplicates.parity_map(b, 4 * wide(len(b))).tolist())))
    one = "struct<n:int,parity:array<long>>"
    df = spark.createDataFrame(rows, f"i int, x {one}, y {one}").select("i", near_duplicates._alike(F.col("x"), F.col("y"), least).alias("ok"))
    got = df.collect()
    assert all(r["ok"] for r in got if truth[r["i"]])
    assert sum(r["ok"] for r in got if not truth[r["i"]]) <= 0.35 * sum(not truth[r["i"]] for r in got)
