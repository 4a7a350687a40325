"""Search chunks against a plain fold, message by message."""

import hashlib
import math
import random

import pytest
import regex

from threadloom.operators import chunks

WEIGHTY = regex.compile(r"[\p{Script=Han}\p{Extended_Pictographic}]")


def weight(text):
    return math.ceil(sum(1 if WEIGHTY.match(c) else 0.25 for c in text))


def grams(text):
    out = []
    for m in regex.finditer(r"\p{Script=Han}+", text):
        out += [m[0][i : i + n] for n in (2, 3) for i in range(len(m[0]) - n + 1)]
    return " ".join(dict.fromkeys(out + [w.lower() for w in regex.findall(r"(?i)[a-z0-9_:@.-]+", text)]))


def plain(messages, most, overlap):
    """The fold as one reads it: units of a conversation in order, one at a time."""
    out = []
    convs = {}
    for m in messages:
        convs.setdefault(m[0], []).append(m)
    for conv, rows in convs.items():
        held, index, dirty = [], 0, False

        def emit():
            nonlocal held, index, dirty
            text = "\n".join(f"{u[3] or u[2] or ''}: {u[5]}" for u in held)
            ident = "\n".join(["" if conv is None else conv, held[0][1], held[-1][1], str(index), text])
            out.append((conv, index, hashlib.sha256(ident.encode()).hexdigest(), held[0][1], held[-1][1], held[0][0], held[-1][0], held[0][4], held[-1][4], list(dict.fromkeys(u[2] for u in held if u[2])), sum(u[6] for u in held), text, grams(text)))
            tail, left = [], overlap
            for u in reversed(held):
                if left <= 0:
                    break
                if u[6] <= left:
                    tail.insert(0, u)
                    left -= u[6]
                    continue
                k = next(k for k in range(1, len(u[5]) + 1) if weight(u[5][-k:]) >= left)
                tail.insert(0, (*u[:5], u[5][-k:], weight(u[5][-k:])))
                left = 0
            held, index, dirty = tail, index + 1, False

        for _, seq, uid, sender, name, at, text in sorted(rows, key=lambda r: r[1]):
            rest = (text or "").strip()
            while rest:
                k = len(rest)
                if weight(rest) > most - overlap:
                    k = next(k for k in range(1, len(rest)) if weight(rest[: k + 1]) > most - overlap)
                piece, rest = rest[:k], rest[k:]
                if held and sum(u[6] for u in held) + weight(piece) > most:
                    emit()
                held.append((seq, uid, sender, name, at, piece, weight(piece)))
                dirty = True
                if sum(u[6] for u in held) == most:
                    emit()
        if held and dirty:
            emit()
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "index", "chunk_id", "first_uid", "last_uid", "first_sequence", "last_sequence", "start_time", "end_time", "sender_ids", "token_count", "text", "ngrams"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def talk(rng, convs, n, longest):
    rows = []
    for c in convs:
        for i in range(n):
            text = "".join(rng.choice(["深度", "学习", "plan_a ", "x", "é", "😀", " ", "\n", "no", "©", "🀄"]) for _ in range(rng.randrange(longest)))
            rows.append((c, i, f"{c}-{i}", rng.choice(["ann", "bob", "", None]), rng.choice([None, "", "Ann"]), 60 * i, rng.choice([text, text, text, None, "", " 　"])))
    return rows


SCHEMA = "conv_id string, canonical_seq long, message_uid string, sender string, sender_name string, occurred_at_epoch_s long, text string"


@pytest.mark.parametrize("most,overlap,tokens,messages", [(20, 4, 65_536, 4096), (20, 4, 40, 7), (12, 11, 30, 3), (9, 0, 16, 5), (50, 20, 64, 4096)])
def test_chunks_equal_a_plain_fold(spark, monkeypatch, most, overlap, tokens, messages):
    """Blocks of a few units each: every chunk boundary crosses some."""
    monkeypatch.setattr(chunks, "TOKENS", tokens)
    monkeypatch.setattr(chunks, "MESSAGES", messages)
    rows = talk(random.Random(most), ["p", "q", None], 60, 30) + [("one", 0, "one-0", None, None, None, "汉" * 900 + "😀"), ("none", 0, "u", "s", None, 1, " ")]
    assert got(chunks.chunk_messages(spark.createDataFrame(rows, SCHEMA), most, overlap)) == plain(rows, most, overlap)


def test_chunks_of_nothing(spark):
    assert chunks.chunk_messages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chunks.chunk_messages(spark.createDataFrame([("c", 1, "u", "a", "b", 2, None)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        chunks.chunk_messages(spark.createDataFrame([], SCHEMA), 80, 80)


def test_weights_are_those_of_the_unicode_properties(spark):
    """The property as Unicode 15 has it; later versions of it hold less."""
    from pyspark.sql import functions as F

    from threadloom.functions import scalars

    points = spark.range(0x20, 0x30000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    heavy = {r["id"] for r in points.filter(scalars.point_weight(F.col("c")) == 1.0).collect()}
    want = {i for i in range(0x20, 0x30000) if not 0xD800 <= i <= 0xDFFF and WEIGHTY.match(chr(i))}
    fixed = {i for a, b in regex.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", scalars.PICTOGRAPHS) for i in range(int(a, 16), int(b or a, 16) + 1)}
    other = {i for i in heavy | want if not regex.match(r"\p{Script=Han}", chr(i))}  # how many characters are Han depends on the JDK's Unicode
    assert want & other <= heavy & other <= fixed <= heavy


def test_light_texts_and_short_conversations_equal_a_plain_fold(spark):
    """Texts without heavy characters, whose ends are counted, not weighed; conversations of one chunk, which no fold sees."""
    rng = random.Random(3)
    words = ["Plan_A ", "x", "no ", "\n", "12:30 ", "é", "É", "ß"]
    rows = [(c, i, f"{c}-{i}", "ann", None, i, "".join(rng.choice(words[: 5 if c % 2 else 8]) for _ in range(rng.randrange(n)))) for c, n in enumerate([30, 30, 3, 3, 2, 12, 12, 60]) for i in range(1 + 3 * c)]
    rows = [(str(r[0]), *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    for most, overlap in ((20, 4), (12, 11), (9, 0), (70_000, 80)):
        assert got(chunks.chunk_messages(df, most, overlap)) == plain(rows, most, overlap)
    plan = chunks.chunk_messages(df, 20, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 20)" in plan and "> 20)" in plan
