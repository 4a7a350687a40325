"""Spelling variants against all pairs, on words of any kind and on whole tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import LONG, ODD, SCHEMA
from threadloom.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute_words(rows, shortest=5, fewest=3):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def groups(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_neighbourhoods_hold_every_edit_once():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    s = spelling.Spellings(words)
    values = spelling.symbol_of(s.points, 3)
    reduced = lambda w: "".join(str(int(x)) for x in spelling.symbol_of(spelling.Spellings([w]).points, 3))

    def code(r):
        return sum(int(c) * pow(spelling.BASE, i, 2**64) for i, c in enumerate(r)) % 2**64

    word, found = s.neighbours(values, 3)
    for i, w in enumerate(words):
        r = reduced(w)
        want = {r} | {r[:j] + r[j + 1 :] for j in range(len(r))} | {r[:j] + c + r[j + d :] for j in range(len(r) + 1) for c in "123" for d in (0, 1)}
        assert sorted(found[word == i].tolist()) == sorted(map(code, want))


@pytest.mark.parametrize("symbols,crowd", [(3, 65_536), (3, 4), (16, 0), (5, 30)])
def test_near_words_against_all_pairs(spark, symbols, crowd):
    rng = random.Random(symbols * 100 + crowd)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(300)} | {"x" * i for i in (30, 31, 33, 400, 401)} | {"\U0001f600a", "\U0001f600b"}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, symbols, crowd).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_long_chains_end_at_one_root(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [(f"x{i}", "w000") for i in range(20)]
    got = spelling.follow_forms(spark.createDataFrame(forms, "word string, form string")).collect()
    assert len(got) == 60 and {r["root"] for r in got} == {"w040"}


def test_op11_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert groups(queries.op11_spelling(spark, sf)) == brute_groups(brute_words((r["doc_id"], r["text"]) for r in docs))


@pytest.mark.parametrize("rows", [ODD, [], [(i, t, None, None) for i, t in enumerate([LONG + "y" * 20000 + " " + "y" * 20001] * 3 + ["ÀÉÎ÷×ÿabc KelvinKelvin ﬁfth ŁódźŁódź"] * 4 + ["Colour color COLOR color colour color color colouur colouur colouur"] * 3)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "r", "g", 2, "s", "h", 3, "k", 4, 5, 6, 7) for i, t, lang, s in rows], SCHEMA)
    df = df.withColumns({c: F.lit("clash") for c in ("word", "n", "run", "cls", "form", "parity")})
    assert groups(spelling.group_spellings(df)) == brute_groups(brute_words((i, t) for i, t, *_ in rows))
