"""Each stage of the pipeline against brute force on what the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm import ODD, SCHEMA, brute_lines, brute_pieces, brute_targets, gapless
from tests.llm.test_similar import brute_kept
from threadloom.llm import language_id
from threadloom.llm.common import WORD, materialize  # noqa: F401
from threadloom.llm.queries import pipeline, tokenizer_path  # noqa: F401


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf):
    import re

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = materialize(stages["language ID"](spark, docs, sf))
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    assert set(texts(kept)) == {d for d, (p, s) in said.items() if p != "und" and s >= 0.5} and kept.columns == docs.columns
    lines = materialize(stages["line dedup"](spark, kept, sf))
    want = brute_lines(texts(kept))
    old = texts(kept)
    assert texts(lines) == {d: t for d, t in want.items() if t.strip(" ") or t == old[d]} and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    unique = materialize(stages["SimHash near-dedup"](spark, lines, sf))
    assert set(texts(unique)) == brute_kept(texts(lines))[0] and unique.columns == docs.columns
    mixed = materialize(stages["mixing"](spark, unique, sf))
    size = {r["doc_id"]: (r["source"], len(re.findall(WORD, r["text"]))) for r in unique.collect()}
    per = Counter()
    for s, n in size.values():
        per[s] += n
    taken, times = Counter(), Counter(r["doc_id"] for r in mixed.collect())
    for d, n in times.items():
        assert n <= 3
        taken[size[d][0]] += n * size[d][1]
    largest = {s: max(n for x, n in size.values() if x == s) for s in per}
    assert all(abs(taken[s] - t) <= largest[s] for s, t in brute_targets(dict(per)).items()) and mixed.columns == docs.columns
    packed = stages["packing"](spark, mixed, sf).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(brute_pieces([(r["doc_id"], r["text"]) for r in mixed.collect()]))
    gapless(packed)
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(tuple(r)[:5] for r in packed)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, sf, rows):
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "r", "g", 2, "s", "h", 3, "k", 4, 5, 6, 7) for i, t, lang, s in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        assert out.count() <= 3 * len(rows)
        df = materialize(out)
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() >= (1 if rows else 0)
