"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import ann, compression, language_id, line_dedup, mixing, near_duplicates, packing, pii, queries, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 4000
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", None, "a"), (4, "one two three four", "en", None), (5, "one two three four", "en", None), (5, "one two three four", "en", None), (None, "one two\nthree", "fr", "b"), (7, LONG, "en", "a"), (8, "x" * 30000, "en", "c"), (9, "Çédille été naïve", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, g string, th int, spans string, h string, b int, key string, fp int, length int, rank int, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1, "r", "g", 2, "s", "h", 3, "k", 4, 5, 6, 7) for i, t, l, s in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1 toxicity

def test_toxicity_on_held_out_labels(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train_chain(d, labels.filter("doc_id % 3 <> 0"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, least=3)
    got = toxicity.score_toxicity(d, chain).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("flagged", "toxic").collect()
    right = sum(r["flagged"] == bool(r["toxic"]) for r in got)
    assert right >= 0.95 * len(got)


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(odd, labels, {"toxic": F.col("toxic") == 1})
    assert toxicity.score_toxicity(odd, chain).count() == len(ODD)
    assert toxicity.train_chain(none, labels, {"toxic": F.col("toxic") == 1}) is None
    assert toxicity.score_toxicity(odd, None).filter("flagged").count() == 0
    assert toxicity.score_toxicity(none, chain).count() == 0


def test_chain_passes_probabilities_on():
    """Forward pass and out-of-fold inputs against plain loops."""
    g = np.random.default_rng(2)
    texts = [" ".join(g.choice(["vile", "scum", "rose", "lake", "tree", "moss"], 6)) for _ in range(60)]
    y = np.array([["scum" in t, "vile" in t] for t in texts]).astype(int)
    chain = toxicity.Chain(["a", "b"], [b"vile", b"scum"])
    x, fold = chain.features(texts), np.arange(60) % 5
    other = toxicity.Chain(["a", "b"], [b"rose", b"lake", b"scum"]).features(texts)
    chain.fit(x, y, fold, [x, other, x, other, x])
    out = np.zeros(60)
    for f in range(5):
        own = other if f % 2 else x
        w = toxicity.fit_logistic(own[fold != f], y[fold != f, 0].astype(float), 0.2)
        for i in np.flatnonzero(fold == f):
            out[i] = 1 / (1 + math.exp(-min(30, max(-30, own[i] @ w[:-1] + w[-1]))))
    assert np.allclose(chain.weights[1], toxicity.fit_logistic(np.hstack([x, out[:, None]]), y[:, 1].astype(float), 0.2))
    for t, p in zip(texts, chain.predict(texts), strict=True):
        v = chain.features([t])[0]
        one = 1 / (1 + math.exp(-(v @ chain.weights[0][:-1] + chain.weights[0][-1])))
        two = 1 / (1 + math.exp(-(v @ chain.weights[1][:-2] + one * chain.weights[1][-2] + chain.weights[1][-1])))
        assert np.allclose(p, [one, two])


def test_telling_words_leave_the_fold_out(spark):
    rows_ = [(i % 2, [int(i < 20)], ["both"] + (["bad"] if i < 20 else []) + (["even"] if i < 20 and i % 2 == 0 else [])) for i in range(200)]
    df = spark.createDataFrame([(f, y, [w.encode() for w in ws]) for f, y, ws in rows_], "fold int, y array<int>, words array<binary>")
    got = toxicity.telling_words(df, 2, 1, 10, 3)
    assert set(got[0]) == {b"bad"} and set(got[1]) == {b"bad", b"even"} and set(got[2]) == {b"bad", b"even"}


# 2 mixing

def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / free for s in names}
        over = {s for s in names if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 500, None: 3}, {"z": 0, "y": 7, "x": 9}, {c: 2**i for i, c in enumerate("abcdefgh")}])
def test_mixing_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mixing_takes_near_targets(spark, sf):
    got = queries.op2_mixing(spark, sf).collect()
    per = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["target"], r["source_size"]].append(r)
    for (target, _), rs in per.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    assert sorted(map(tuple, got), key=repr) == sorted(rows(queries.op2_mixing(spark, sf)), key=repr)


def test_mixing_rows_are_in_position_order(spark, odd, none):
    assert mixing.mix_documents(none).count() == 0
    got = mixing.mix_documents(odd)
    assert got.columns == odd.columns
    plan = mixing.plan_curriculum(odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("th")), len(ODD))
    assert got.count() == plan.agg(F.sum("copies")).first()[0]
    x = spark.range(101).select((F.col("id") / 100).alias("u"))
    for i, knots in enumerate(mixing.SCHEDULES):
        k = F.element_at(mixing._schedule_column(mixing.SCHEDULES), i + 1)
        t = [r[0] for r in x.select(mixing.invert_demand(k, F.col("u"))).collect()]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        dense = np.interp(np.linspace(0, 1, 20001), [a for a, _ in knots], [b / area for _, b in knots])
        cum = np.concatenate([[0], np.cumsum((dense[1:] + dense[:-1]) / 2 / 20000)])
        assert np.allclose(np.interp(t, np.linspace(0, 1, 20001), cum), np.arange(101) / 100, atol=1e-4)


# 3 line dedup

def brute_lines(texts):
    first, cover = {}, defaultdict(set)
    for d in sorted(texts):
        at = [(i, l.strip(" \t\n\r\v\f")) for i, l in enumerate(texts[d].split("\n")) if WORD.search(l)]
        for k in range(len(at) - 2):
            key = tuple(l for _, l in at[k : k + 3])
            if first.setdefault(key, (d, k)) != (d, k):
                cover[d] |= {i for i, _ in at[k : k + 3]}
    return {d: "\n".join(l for i, l in enumerate(t.split("\n")) if i not in cover[d]) for d, t in texts.items()}


def test_line_dedup(spark, sf, docs):
    got = {r["doc_id"]: r["text"] for r in queries.op3_line_dedup(spark, sf).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_small(spark, odd, none):
    t = {1: "a\nb\nc\nd", 2: "x\n a\nb \n\nc\ny", 3: "q\nq\nq\nq\nq", 4: "", 5: "a\nb"}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(t) and got[2] == "x\n\ny" and got[3] == "q"
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "line_dedup"] and out.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    clash = odd.withColumn("line_dedup", F.lit(1))
    assert line_dedup.dedup_lines(clash).columns == [*clash.columns, "line_dedup_"]
    assert line_dedup.keep_new_lines(clash).columns == clash.columns


# 4 language ID

def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_odd(odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == len(ODD) and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert language_id.identify(none).count() == 0
    assert language_id.keep_identified(odd, least=0.0).columns == odd.columns
    x, owner, size = language_id.windows_of([LONG, "", "abc"])
    assert (np.bincount(owner) > 0).all() and x[-1][:4].tobytes() == b"abc\0"
    whole = LONG.encode().lower()
    assert b"".join(w[: language_id.STEP].tobytes() for w in x[owner == 0]).rstrip(b"\0")[: len(whole)] == whole[: language_id.STEP * (owner == 0).sum()]


def test_network_forward_pass():
    """Embedding, filters of three widths, max, rectifier and softmax against plain loops over bytes."""
    net = language_id.ByteConvNet(["a", "b", "c"], seed=1)
    net.bias = np.linspace(-0.5, 0.5, len(net.bias)).astype(np.float32)
    x, _, _ = language_id.windows_of(["Plain words, and more of them. " * 9, "été"])
    got = net.predict(x)
    for window, p in zip(x, got, strict=True):
        h = np.zeros(language_id.FILTERS * 3)
        for f in range(len(h)):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            at = [
                sum(float(net.embed[window[i + j]] @ net.conv[j * language_id.EMBED : (j + 1) * language_id.EMBED, f]) for j in range(width))
                for i in range(language_id.STEP)
            ]
            h[f] = max(0.0, max(at) + float(net.bias[f]))
        z = np.exp(h @ net.out + net.out_bias)
        assert np.allclose(p, z / z.sum(), atol=1e-4)


def test_language_is_learned_from_rows_that_share_an_id(spark):
    """Rows without a doc_id and rows of one doc_id teach row by row; a hundred languages are all classes; copies do not break the bound."""
    text = {f"l{i:03d}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + j) % 26)}" for j in range(60)) for i in range(100)}
    rows_ = [(None if k % 2 else 8, f"{t} {k}", lang) for lang, t in text.items() for k in range(4)] + [(None, "same same", "l000")] * 50
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    net = language_id.train(df, per_language=10)
    assert net.classes == sorted(text)
    one = spark.createDataFrame([(8, "same same", "x")] * 30, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(one, per_language=5).collect()} == {"x"}


# 5 nearest neighbours

def brute_nearest(v, k=5):
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids]).astype(np.float64)
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    return {int(q): [(int(ids[j]), s[j]) for s in [m @ m[a]] for j in np.lexsort((ids, -np.round(s, 12))) if j != a][:k] for a, q in enumerate(ids) if q % 50 == 0}


def test_nearest_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.nearest(e, F.col("vec_id") % 50 == 0, leaf_rows=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest({r["vec_id"]: np.array(r["embedding"]) for r in e.collect()})
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    scores = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - scores.get((q, i), s)) < 1e-12 for q in got for i, s in got[q])


def test_nearest_odd(spark):
    g = np.random.default_rng(0)
    bad = [(50, None), (100, []), (150, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (250, [float("nan"), 1.0, 0.0, 0.0]), (300, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (350, [1.0, 2.0])]
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000, 1200)]
    other = [(i, [float(x) for x in g.normal(size=4)]) for i in range(1, 40)]
    df = spark.createDataFrame(bad + same + other + same[:1], "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank"))
    want = brute_nearest({i: np.array(v, dtype=np.float32) for i, v in same + other}) | brute_nearest({350: np.array([1.0, 2.0])})
    assert [(q, i) for q, _, i, _ in got] == [(q, i) for q in sorted(want) for i, _ in want[q]]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [r[:3] for r in rows(ann.nearest(few, F.col("vec_id") % 50 == 0))] == [(0, 1, 1)]


def test_nearest_ties_and_lengths(spark):
    """Equal cosines go to the smaller ids, however many tie; each length is searched on its own."""
    g = np.random.default_rng(12)
    base = g.normal(size=8).astype(np.float32)
    tied = [(i, [float(x) for x in base * np.float32(2.0) ** (i % 20)]) for i in range(49, 0, -1)]
    asks = [(0, [float(x) for x in base + g.normal(size=8) * 0.1])]
    rest = [(i, [float(x) for x in g.normal(size=8)]) for i in range(101, 300)]
    short = [(i, [float(x) for x in g.normal(size=3)]) for i in range(1000, 1060)] + [(1100, [1.0])]
    df = spark.createDataFrame(asks + tied + rest + short, "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank"))
    assert [i for q, _, i, _ in got if q == 0] == [1, 2, 3, 4, 5]
    for part in (asks + tied + rest, short[:-1]):
        want = brute_nearest({i: np.array(v, dtype=np.float32) for i, v in part})
        assert {q: [i for a, _, i, _ in got if a == q] for q in want} == {q: [i for i, _ in w] for q, w in want.items()}
    assert not any(q == 1100 for q, *_ in got)


def test_shards_hold_every_leaf():
    counts = {0: 5, 1: 9000, 2: 1, 4: 2048, 5: 2000}
    got = ann.shards_of(counts, 7, 2048)
    rows_of = Counter()
    for leaf, s in got.items():
        for x in s:
            rows_of[x] += math.ceil(counts.get(leaf, 0) / len(s))
    assert len(got) == 7 and len(got[1]) == 5 and max(rows_of.values()) <= 2048
    assert not set(got[1]) & {x for leaf, s in got.items() if leaf != 1 for x in s}


# 6 compression bands

def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_compression(spark, sf, docs, odd, none):
    got = queries.op6_compression_bands(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {d: brute_measures(t) for d, t in docs.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert sorted(tuple(r)[1:7] for r in compression.compression_quality(odd).collect()) == sorted(brute_measures(t) for _, t, *_ in ODD)
    assert compression.compression_quality(none).count() == 0


def brute_bands(docs):
    """doc_id -> (ratio, bad chunks, chunks, kept), one text at a time."""
    import math

    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    seen = {}
    for d, t in docs.items():
        raw = (t or "").encode()
        at = [*range(0, len(raw) - 4096, 4096), len(raw) - 4096] if len(raw) > 4096 else []
        half = math.floor(2 * math.log2(max(1, len(raw))))
        seen[d] = (len(raw), half, len(raw) / size(raw) if raw else 0.0, [4096 / size(raw[i : i + 4096]) for i in at])
    passed = {d for d in docs if not brute_measures(docs[d])[5]}

    def fence(values):
        q = np.percentile(np.floor(np.array(values) * 1000 + 0.5) / 1000, [25, 50, 75])
        side = [6 * max(abs(q[1] - q[k]) / 0.6745, 0.025 * q[1]) for k in (0, 2)]
        return q[1] - side[0], q[1] + side[1]

    once = {(n, r): (h, c) for d, (n, h, r, c) in seen.items() if d in passed}
    per = {}
    for (_, r), (h, _) in once.items():
        per.setdefault(h, []).append(r)
    per = {h: fence(v) for h, v in per.items() if len(v) >= 100}
    chunks = [x for _, c in once.values() for x in c]
    chunk_low, chunk_high = fence(chunks) if len(chunks) >= 100 else (1.3, 4.0)
    out = {}
    for d, (n, h, r, c) in seen.items():
        least, most = [(lo, hi) for low, lo, hi in compression.OUTER if 2 ** ((h + 1) / 2) > low][-1]
        shorter, longer = [k for k in per if k <= h], [k for k in per if k >= h]
        low = max(least, per[max(shorter)][0]) if shorter else least
        high = min(most, per[min(longer)][1]) if longer else most
        bad = sum(not max(chunk_low, 1.3) <= x <= min(chunk_high, 4.0) for x in c)
        out[d] = (r, bad, len(c), d in passed and (n < 256 or low <= r <= high) and 2 * bad <= len(c))
    return out


def test_compression_verdicts(spark):
    """ratio, chunks and kept against brute force; beyond the base rule something is rejected, and it is junk."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op6_compression_bands(spark, sf).collect()}
    want = brute_bands(texts)
    for d, (ratio, bad, chunks, kept) in want.items():
        r = got[d]
        assert abs(r["ratio"] - ratio) < 1e-9 and (r["bad_chunks"], r["chunks"], r["kept"]) == (bad, chunks, kept), d
    gone = [r for r in got.values() if not r["base_failed"] and not r["kept"]]
    assert gone and all(20 * r["n_symbols"] > r["word_chars"] for r in gone)


def test_compression_measures_every_byte(spark):
    """The tail of a long text, and texts that hardly exceed a chunk, count like other chunks."""
    g = np.random.default_rng(5)
    good = " ".join("".join(chr(97 + int(c)) for c in g.integers(0, 12, int(g.integers(2, 9)))) for _ in range(4000)).encode()
    noise = bytes(33 + int(x) for x in g.integers(0, 90, 8000))
    cases = {0: good[:4096], 1: good[:4097], 2: good[:4000] + noise[:4192], 3: good[:4096] + noise[:7904], 4: good[:12300]}
    df = spark.createDataFrame([(i, b.decode()) for i, b in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["bad_chunks"], r["chunks"]) for r in compression.compression_quality(df).collect()}
    assert got == {0: (0, 0), 1: (0, 2), 2: (1, 2), 3: (2, 3), 4: (0, 4)}


def test_copies_do_not_set_the_limits(spark):
    """Two thirds of all rows are one text; the others, in its length class, stay."""
    g = np.random.default_rng(6)
    words = ["".join(chr(97 + int(c)) for c in g.integers(0, 26, int(g.integers(2, 9)))) for _ in range(2000)]
    texts = [" ".join(g.choice(words, 200)) for _ in range(150)] + [" ".join(g.choice(words, 200))] * 300
    got = compression.compression_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["kept"] for r in got)


# 7 URL filters

def test_url_filters(spark):
    e = spark.createDataFrame([("bad.org", 10, "add", "x"), ("bad.org", 20, "remove", None), ("bad.org", 30, "add", "y"), ("a.bad.org", 15, "add", "z"), (None, 1, "add", "n"), ("same.org", 5, "add", "q"), ("same.org", 5, "remove", None)], "key string, day int, action string, category string")
    urls = [(1, "http://www.bad.org/x", 9), (2, "http://www.bad.org/x", 10), (3, "http://bad.org:80", 19), (4, "http://BAD.org./", 20), (5, "https://u@x.a.bad.org?q", 300), (6, None, 12), (7, "nonsense", 12), (8, "http://notbad.org", 12), (9, "http://bad.org", None), (10, "http://same.org", 6), (5, "https://u@x.a.bad.org?q", 300)]
    c = spark.createDataFrame([(*u, "clash") for u in urls], "page_id int, url string, day int, key string")
    got = {r["page_id"]: r["matched"] and (r["matched"], r["category"]) for r in url_filter.filter_captures(c, url_filter.validity_intervals(e)).collect()}
    assert got == {1: None, 2: ("bad.org", "x"), 3: ("bad.org", "x"), 4: None, 5: ("a.bad.org", "z"), 6: None, 7: None, 8: None, 9: None, 10: None}
    assert url_filter.filter_captures(c.limit(0), url_filter.validity_intervals(e)).count() == 0
    assert url_filter.filter_captures(c, url_filter.validity_intervals(e.limit(0))).filter("blocked").count() == 0


# 8 packing

def brute_pieces(texts, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), capacity):
            c = ids[p : p + capacity]
            yield d, p // capacity, p, len(c), zlib.crc32(np.array(c, "<u4").tobytes())


def gapless(got, capacity=4096):
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_packing(spark, sf, docs):
    got = queries.op8_packing(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute_pieces(docs.items()))
    used = gapless(got)
    assert used <= 1.02 * sum(r["length"] for r in got) / 4096 + 1


def test_packing_odd(spark, odd, none):
    more = [(10, "<|endoftext|> <|ENDOFTEXT|> Áé don't 'REinvent ÉCOLE ß İi Σας ﬁ x y a1b2 ,,, été!!! naïve;"), (11, "  　")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = packing.pack_documents(df, queries.tokenizer_path(), with_ids=True).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute_pieces([(d, t) for d, t, *_ in ODD] + more), key=key)
    gapless(got)
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_tokenizer(name, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    tok, words = Tokenizer.from_file(path), packing.WordIds(path)
    assert words.by_word == name.startswith("word")
    for t in [*list(docs.values())[:60], "a  b\tc", "<|endoftext|>x <|ENDOFTEXT|>"]:
        assert list(memoryview(words.text(t)).cast("I")) == tok.encode(t, add_special_tokens=False).ids


def test_packing_plans_hold_every_item():
    g = np.random.default_rng(5)
    for _ in range(200):
        c = int(g.choice([10, 30, 100]))
        h = Counter(int(x) for x in g.integers(1, c + 1, g.integers(0, 60)))
        seq, ranks = defaultdict(list), Counter()
        for length, r0, n, s0, each, o in packing.plan_slots(dict(h), c):
            assert r0 == ranks[length]
            ranks[length] += n
            for i in range(n):
                seq[s0 + i // each].append((o + i % each * length, length))
        assert ranks == h
        for s in seq.values():
            end = 0
            for o, n in sorted(s):
                assert o == end
                end += n
            assert end <= c


def test_dominance_keeps_the_optimum():
    def best(items, c):
        items, lowest = sorted(items, reverse=True), len(items)

        def go(i, bins):
            nonlocal lowest
            if len(bins) >= lowest:
                return
            if i == len(items):
                lowest = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= c and bins[b] not in bins[:b]:
                    go(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return lowest

    g = np.random.default_rng(9)
    for _ in range(150):
        items = [int(x) for x in g.integers(2, 21, g.integers(1, 9))]
        counts = dict(Counter(items))
        fixed = sum(n for _, n in packing.reduce_dominated(counts, 20))
        assert fixed + best(list(Counter(counts).elements()), 20) == best(items, 20)


# 9 SimHash

def brute_print(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    root = {p: p for p in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    low = {}
    for d, p in prints.items():
        low[find(p)] = min(d, low.get(find(p), d))
    return {d: low[find(p)] for d, p in prints.items()}


def test_simhash(spark, sf, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf).collect()}
    prints = {d: brute_print(t, 3) for d, t in docs.items()}
    comp = brute_components(prints)
    assert got == {d: (f"{p:016x}", comp[d]) for d, p in prints.items()}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    g = np.random.default_rng(1)
    base = [int(x) for x in g.integers(0, 2**63, 6)]
    ps = {b ^ sum(1 << int(i) for i in g.integers(0, 64, g.integers(0, 4))) for b in base for _ in range(40)}
    ps = {p - ((p >> 63) << 64) for p in ps}
    df = spark.createDataFrame([(p,) for p in ps], "fp long")
    got = {r["node"]: r["root"] for r in near_duplicates.components(near_duplicates.close_links(df, crowd=crowd)).collect()}
    want = brute_components({p: p % 2**64 for p in ps})
    groups = lambda m: {frozenset(v) for v in _invert(m).values()}
    assert groups({p: got.get(p, p) for p in ps}) == groups(want)


def _invert(m):
    out = defaultdict(set)
    for k, v in m.items():
        out[v].add(k)
    return out


def test_components_of_a_long_chain(spark):
    n = 300
    g = np.random.default_rng(2).permutation(n)
    df = spark.createDataFrame([(int(g[i]), int(g[i + 1])) for i in range(n - 1)], "a long, b long")
    got = near_duplicates.components(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).collect()
    assert {r["root"] for r in got} == {0} and len(got) == n - 1


def test_simhash_odd(odd, none):
    got = near_duplicates.near_duplicate_components(odd, shingle=3)
    assert got.count() == len(ODD)
    assert {r["component_id"] for r in got.filter("doc_id in (1, 2, 3)").collect()} == {1}
    kept = near_duplicates.drop_near_duplicates(odd, shingle=3)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i) == [1, 4, 7, 8, 9] and ids.count(None) == 1
    assert near_duplicates.near_duplicate_components(none, shingle=3).count() == 0


# 10 personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_of(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def test_personal_data(spark, docs):
    for sf in ("/root/testdata/sf0.01",):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        for r in queries.op10_personal_data(spark, sf).collect():
            want = brute_spans(texts[r["doc_id"]])
            n = Counter(x[3] for x in want)
            assert tuple(r)[1:5] == tuple(n[k] for k in KINDS)
            assert r["base_sha256"] == hashlib.sha256(base_of(want).encode()).hexdigest()
            assert [x for x in r["spans"].split(",") if x and not x.startswith("term")] == [x for x in base_of(want).split(",") if x]


def test_personal_data_odd(spark, odd, none):
    hard = ["a@b.c_d@e.f x@y@z.com", "1.2.3.4.5 256.1.1.1 1.2.3.0004 00255.1.1.1 99999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 ++49 (0)30 123456-7", "+1 (555) 010-9999.", "9" * 50000, "é\U0001f600 me@x.org " * 3, "a" * 50000 + "@", "@".join(["a.b"] * 3000), "m@" + "a." * 20000 + "b", "1" + " 1" * 30000, "+1" + "-" * 30000, "1.1.1.1." * 2000]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).select("doc_id", pii.span_text(F.filter("spans", lambda x: x["k"] < 4)).alias("spans")).collect()}
    assert got == {i: base_of(brute_spans(t)) for i, t in enumerate(hard)}
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(none).count() == 0
    assert pii.sanitize(odd).columns == odd.columns


def test_terms_that_disclose_are_found(spark):
    g = np.random.default_rng(4)
    words = ["w" + "".join(chr(97 + int(c)) for c in g.integers(0, 26, 4)) for _ in range(300)]
    filler = lambda: " ".join(g.choice(words, 30))
    t = [f"{filler()} hannibal owns me@x.org {filler()}" for _ in range(5)] + [f"{filler()} you@y.org {filler()}"] + [filler() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).collect()}
    marked = {t[i][x["s"] : x["e"]] for i, s in got.items() for x in s if x["k"] == 4}
    assert "hannibal" in marked and "owns" in marked and not any(x["k"] == 4 for x in got[5])
    clean = pii.sanitize(df).filter("doc_id = 0").first()["text"]
    assert "hannibal" not in clean and "me@x.org" not in clean and "[EMAIL]" in clean


def test_bands_reject_repetition_and_noise(spark):
    import base64

    g = np.random.default_rng(3)
    words = ["".join(chr(97 + int(c)) for c in g.integers(0, 26, int(g.integers(2, 9)))) for _ in range(400)]
    prose = lambda n: " ".join(g.choice(words, n))
    noise = " ".join(base64.b64encode(g.bytes(30)).decode() for _ in range(600))
    same = [prose(8) for _ in range(3)]
    loop = "\n".join(f"{same[i % 3]} {prose(1)}" for i in range(400))
    df = spark.createDataFrame([(1, prose(200)), (2, prose(3000)), (3, noise), (4, loop)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in compression.compression_quality(df).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_addresses_of_four_numbers_have_no_parents(spark):
    hosts = ["1.2.3.4", "a.b.example.org", "org", ""]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(url_filter.domain_keys(F.col("h")).alias("k")).collect()
    assert [r["k"] for r in got] == [["1.2.3.4"], ["a.b.example.org", "b.example.org", "example.org"], ["org"], [""]]


def test_rows_without_an_id_spread_over_buckets(spark):
    """Mixing and packing deal rows by what they hold, not by doc_id alone."""
    df = spark.createDataFrame([(None, f"word {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    sizes = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("th"))
    plan = mixing.mix_sizes(sizes, 400)
    assert plan.agg(F.sum("taken")).first()[0] == 800 and plan.select("position").distinct().count() == 400
    packed = packing.pack_documents(df, queries.tokenizer_path())
    assert packed.count() == 400 and packed.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_languages_of_copies_are_all_learned(spark):
    """Thousands of rows that repeat one document each, without an id: every language is drawn from and found."""
    words = {"de": "straße größe über müßig", "fr": "été où garçon naïve", "en": "the which through", "es": "niño mañana ¿qué", "xx": "zzq qqz zqz"}
    rows = [(None, f"{t} " * 20, lang) for lang, t in words.items() for _ in range(2000)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert {r["lang_pred"] for r in got.select("lang_pred").distinct().collect()} == set(words) and got.count() == 10_000
