"""Disclosing terms are marked wherever they stand, not only beside the entity."""

import re

import numpy as np

from threadloom.llm import pii


def test_terms_are_marked_in_whole_texts_and_in_other_documents(spark):
    g = np.random.default_rng(4)
    words = ["w" + "".join(chr(97 + int(c)) for c in g.integers(0, 26, 4)) for _ in range(300)]
    filler = lambda n=30: " ".join(g.choice(words, n))
    t = [f"{filler()} hannibal owns me@x.org {filler()}" for _ in range(5)] + [filler() for _ in range(200)]
    t[0] += f" {filler(100)} Hannibal, hannibals \U0001f600 HANNIBAL hannibal@x.org"
    t[9] = f"{filler()} hannibal {filler()}"
    df = spark.createDataFrame([*enumerate(t), (9, t[9])], "doc_id long, text string")
    rows = pii.find_personal_data(df).collect()
    assert len(rows) == len(t) + 1
    for r in rows:
        x = t[r["doc_id"]]
        base = [(s["s"], s["e"]) for s in r["spans"] if s["k"] < 4]
        want = {m.span() for m in re.finditer(r"[^\W\d_]{3,}", x) if m[0].lower() == "hannibal" and not any(s < m.end() and e > m.start() for s, e in base)}
        assert {(s["s"], s["e"]) for s in r["spans"] if s["k"] == 4 and x[s["s"] : s["e"]].lower() == "hannibal"} == want
    assert all("hannibal" not in re.findall(r"\w+", r["text"].lower()) for r in pii.sanitize(df).collect())


def test_time_is_in_proportion_to_matches_and_text(spark):
    """A text of 100,000 addresses and one of 10 million characters, each well under a minute; spans as worked out by hand."""
    import time

    one = lambda text: [(1, text)]
    began = time.monotonic()
    got = pii.find_personal_data(spark.createDataFrame(one("me@x.org " * 100_000), "doc_id long, text string")).collect()
    assert [(x["s"], x["k"], x["e"]) for x in got[0]["spans"]] == [(9 * i, 0, 9 * i + 8) for i in range(100_000)]
    assert time.monotonic() - began < 60
    began = time.monotonic()
    got = pii.find_personal_data(spark.createDataFrame(one("alpha beta 10.0.0.1 gamma, " * 370_000), "doc_id long, text string")).collect()
    base = [(x["s"], x["e"]) for x in got[0]["spans"] if x["k"] == 1]
    assert base == [(27 * i + 11, 27 * i + 19) for i in range(370_000)]
    assert time.monotonic() - began < 60


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 7, 8, 9, 500, 5000):
        df = spark.range(1).select(F.expr(f"transform(sequence(1, {max(n, 1)}), x -> cast(x * 7 % 11 as int))").alias("x"))
        x = F.col("x") if n else F.array().cast("array<int>")
        got = df.select(pii._sums_before(x).alias("s")).first()["s"]
        assert got == [sum(i * 7 % 11 for i in range(1, k)) for k in range(1, n + 1)]


def test_sanitized_texts_are_what_the_spans_say(spark):
    """Long texts with overlapping spans and spans that cross tiles, rewritten by hand from the spans found."""
    g = np.random.default_rng(8)
    parts = ["me@x.org ", "10.20.30.40 ", "+49 170 1234567 ", "4111 1111 1111 1111 ", "x" * 700 + "@y.org ", "\U0001f600 word ", "né ", "+1 10.20.30.41 "]
    texts = ["".join(g.choice(parts, 200)) for _ in range(6)] + [None, "", "plain"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).collect()}
    out = {r["doc_id"]: r["text"] for r in pii.sanitize(df, tile=16).collect()}
    assert len(out) == len(texts) and out[6] is None
    for i, t in enumerate(texts):
        if t is None:
            continue
        want, p = "", 0
        for s in spans[i]:
            if s["s"] >= p:
                want += t[p : s["s"]] + ("" if s["a"] is not None and s["a"] >= 0.9 else f"[{pii.KINDS[s['k']].upper()}]")
            p = max(p, s["e"])
        assert out[i] == want + t[p:]
