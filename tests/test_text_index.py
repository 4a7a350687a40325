"""The search index: query terms, phrases, bounds and the stored form."""

import math
import re

import pytest

from threadloom.operators import search, text_index

SCHEMA = "chunk_id string, conv_id string, first_uid string, last_uid string, last_sequence long, start_time long, end_time long, sender_ids array<string>, text string"


def chunks(spark, *rows):
    base = {"conv_id": "conv-a", "first_uid": "m-start", "last_uid": "m-end", "last_sequence": 1, "start_time": 100, "end_time": 120, "sender_ids": ["u-a"]}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SCHEMA)


def ids(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_han_and_wildcards(spark):
    c = chunks(spark, {"chunk_id": "exact", "text": "季度_计划% 已确认，详情见 example.com"}, {"chunk_id": "related", "text": "季度计划仍需讨论"}, {"chunk_id": "other", "text": "完全无关的内容"})
    i = search.build_index(c)
    assert ids(search.keyword_search(c, i, "季度_计划%", 10))[0] == "exact" and "other" not in ids(search.keyword_search(c, i, "季度_计划%", 10))
    assert sorted(ids(search.keyword_search(c, i, "季度计划", 10))) == ["exact", "related"]
    assert ids(search.keyword_search(c, i, "深度学习 没有", 10)) == []
    assert ids(search.keyword_search(c, i, "我的季度报告", 10)) == ["exact", "related"]  # 季度 alone is shared


def test_ids_and_scope(spark):
    c = chunks(spark, {"chunk_id": "a", "text": "第一条证据", "last_uid": "message-anchor"}, {"chunk_id": "b", "text": "第二条证据", "conv_id": "conv-b", "start_time": 300, "end_time": 320, "sender_ids": ["u-b"]})
    i = search.build_index(c)
    assert ids(search.keyword_search(c, i, "message-anchor", 5))[0] == "a"
    assert ids(search.keyword_search(c, i, "证据", 5, conv="conv-b", sender="u-b", after=250, before=350)) == ["b"]
    assert ids(search.keyword_search(c, i, "证据", 5, conv="conv-b", sender="u-a")) == []


def test_ties_and_bounds(spark):
    c = chunks(spark, *({"chunk_id": x, "text": "共同命中词 alpha", "last_sequence": 5, "start_time": 100, "end_time": 100} for x in "zyxwa"))
    i = search.build_index(c)
    assert ids(search.keyword_search(c, i, "共同命中词", 1)) == ["a"]
    assert ids(search.keyword_search(c, i, "命中 zzz", 1)) == ["a"]
    for q in ("", "  \n", "alpha " + "x" * 500):
        assert ids(search.keyword_search(c, i, q, 5)) == []
    assert len(ids(search.keyword_search(c, i, "alpha", -3))) == 1 and len(ids(search.keyword_search(c, i, " ALPHA ", 1000))) == 5
    assert ids(search.keyword_search(chunks(spark), search.build_index(chunks(spark)), "alpha", 5)) == []
    assert ids(search.keyword_search(chunks(spark, {"chunk_id": "n", "text": None}), search.build_index(chunks(spark, {"chunk_id": "n", "text": None})), "alpha", 5)) == []


def test_phrases_need_neighbours(spark):
    texts = {"side": "the plan a works", "apart": "plan the a", "joined": "see plan_a.b here", "turned": "a plan", "marks": "PLÁN Ä", "twice": "plan a plan a"}
    c = chunks(spark, *({"chunk_id": k, "text": t} for k, t in texts.items()))
    assert search.query_phrases(spark, "Plan_A  x-1 深度学") == [["深度"], ["度学"], ["深度学"], ["plan", "a"], ["x", "1"]]
    hits = {r["chunk_id"]: r["f"] for r in text_index.phrase_hits(search.build_index(c), [["plan", "a"]]).collect()}
    # In the n-grams every word stands once, in order of its first place.
    assert hits == {"side": 1.45, "joined": 1.45, "marks": 1.0, "twice": 2.45}


def plain_bm25(texts, phrases):
    def cut(s):
        return re.findall(r"\w+", s.lower())

    def grams(s):
        return " ".join(dict.fromkeys(re.findall(r"[a-z0-9_:@.-]+", s.lower())))

    docs = {k: {"text": cut(t.replace("_", " ")), "ngrams": cut(grams(t).replace("_", " "))} for k, t in texts.items()}
    size = {k: sum(map(len, d.values())) for k, d in docs.items()}
    avg, out = sum(size.values()) / len(size), {}
    for p in phrases:
        f = {k: sum(w * sum(d[n][i : i + len(p)] == p for i in range(len(d[n]))) for n, w in (("text", 1), ("ngrams", 0.45))) for k, d in docs.items()}
        df = sum(v > 0 for v in f.values())
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
        for k, v in f.items():
            if v:
                out[k] = out.get(k, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * size[k] / avg))
    return out


@pytest.mark.parametrize("store", [False, True])
def test_bm25_against_a_plain_loop(spark, tmp_path, store):
    import random

    rng = random.Random(4)
    texts = {str(i): " ".join(rng.choice(["a", "b", "c", "plan_a", "x.y"]) for _ in range(rng.randrange(1, 30))) for i in range(40)}
    c = chunks(spark, *({"chunk_id": k, "text": t} for k, t in texts.items()))
    index = search.write_index(c, str(tmp_path / "index"), 5) if store else search.build_index(c, 5)
    phrases = [["a"], ["plan", "a"], ["x", "y", "a"], ["b", "b"]]
    got = {r["chunk_id"]: r["score"] for r in search.bm25(index, phrases).collect()}
    want = plain_bm25(texts, phrases)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    if store:
        again = search.read_index(spark, str(tmp_path / "index"))
        plan = text_index.phrase_hits(again, [["c"]])._jdf.queryExecution().toString()
        assert again.buckets == 5 and re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
        assert {r["chunk_id"] for r in search.bm25(again, [["c"]]).collect()} == {k for k, t in texts.items() if "c" in t.split()}
