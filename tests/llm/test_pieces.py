"""The piece codec against the library it must agree with, and against a plain merge loop."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_llm import LONG, ODD, SCHEMA
from threadloom.llm import pieces, queries
from threadloom.llm.pieces import Codec

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
BITS = [" ", "  ", "▁", "a", "b", "e", "th", "in", "x", "0", "1", "\n", "\t", "é", "日", "本", "😀", "\x00", "⁇", "<s>", "<0x41>", "퟿", "ing", "tion", "   ", "T", "́", "."]


@pytest.fixture(scope="module")
def codec():
    return Codec(pieces.model_bytes(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encode_equals_the_library(codec, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [s for n in range(70) for s in (" " * n, "a" + " " * n + "b", " " * n + "the", " " * n + "\n", "\n" + " " * n)]
    texts += ["", "x" * 5000, "ab" * 4000, " " * 5000, "日本" * 3000, LONG, "".join(rng.choice("abcdefghij") for _ in range(20000))]
    assert [g.tolist() for g in codec.encode(texts)] == library.encode(texts)


def test_decode_equals_the_library(codec, library):
    rng = random.Random(6)
    pick = lambda: rng.choice([rng.randrange(32000), rng.randrange(259), rng.randrange(3, 259), 259, 28705])
    for _ in range(4000):
        ids = [pick() for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        codec.decode([32000])


def model(scores, **trained):
    """A small model: pieces and scores; ids 0 to 2 are the unknown, start and end piece."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    for i, p in enumerate(("<unk>", "<s>", "</s>")):
        m.pieces.add(piece=p, score=0, type=2 if i == 0 else 3)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s, type=1)
    m.trainer_spec.model_type = 2
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    m.normalizer_spec.escape_whitespaces = True
    for k, v in trained.items():
        setattr(m.trainer_spec, k, v)
    return m.SerializeToString()


def plain(text, scores):
    """One merge at a time: the best score, then the leftmost."""
    s = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        at = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in scores]
        if not at:
            return s
        i = min(at)[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_any_scores_merge_as_one_by_one(seed):
    """Scores in no order of length, with ties, and pieces across spaces: what a merge makes may come before what is left of the round."""
    rng = random.Random(seed)
    letters = "ab▁" if seed % 2 else "abc"
    scores = {c: float(-rng.randrange(3)) for c in letters}
    while len(scores) < 25:
        scores["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))] = float(-rng.randrange(6 if seed % 3 else 100))
    raw = model(scores)
    codec, library = Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(rng.choice("ab cd") for _ in range(rng.randrange(40))) for _ in range(300)]
    got = [g.tolist() for g in codec.encode(texts)]
    assert got == library.encode(texts)
    ids = {p: i + 3 for i, p in enumerate(scores)}
    want = [[ids.get(p, 0) for p in plain(t, scores)] for t in texts]
    assert got == [[x for i, x in enumerate(w) if x or not i or w[i - 1]] for w in want]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Codec(model({"a": 0.0}, model_type=1))


def test_op12_pieces(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op12_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, library, rows):
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "r", "g", 2, "s", "h", 3, "k", 4, 5, 6, 7) for i, t, lang, s in rows], SCHEMA).withColumn("ids", df_ids()).withColumn("decoded", df_ids())
    raw = pieces.model_bytes(PATH)
    got = pieces.encode_pieces(df, raw)
    key = lambda r: (r[0] is None, r[0] or 0, list(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, library.encode(t or "", add_eos=True)) for i, t, *_ in rows), key=key)
    back = pieces.decode_pieces(got, raw).collect()
    assert sorted(r["text"] for r in back) == sorted(library.decode(library.encode(t or "")) for _, t, *_ in rows)
    assert pieces.encode_pieces(df, raw, eos=False).filter("size(ids) = 0").count() == sum(not t for _, t, *_ in rows)


def df_ids():
    from pyspark.sql import functions as F

    return F.lit("clash")
