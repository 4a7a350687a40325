"""Grouping of spelling variants: words one edit apart, found through their spellings in a reduced alphabet.

Letters are hashed to a few symbols. A word's reduced spelling stands for all words that share it (a class), so the full
one-edit neighbourhood of every reduced spelling is short, and two words one edit apart have reduced spellings that are equal or
one edit apart. Neighbourhoods are joined with the reduced vocabulary, and the words of joined classes are compared as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, stored

#: Maximal runs of letters: A to Z in either case and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base of the polynomial hash modulo 2**64, odd so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def lower_ascii(c: Column) -> Column:
    """c with only A to Z in lower case; lower() alone does it where no capital beyond them occurs."""
    return F.when(c.rlike("[À-Þ]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def letter_runs(docs: DataFrame, every: int = 97) -> DataFrame:
    """word: every run of letters of every text, A to Z in lower case, with one letter deleted where the crc32 of `<doc_id>:<run>`
    is a multiple of every. Null texts have none; a null doc_id is written as nothing."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 0)).alias("run"))
    low = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    marked = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return marked.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """word, n: words of at least shortest code points that occur at least fewest times."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def symbol_of(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol, from 1, that stands for a letter in the reduced alphabet: its number's remainder, which deals an alphabet out evenly."""
    return points % np.uint64(symbols) + np.uint64(1)


class Spellings:
    """Words of a batch as flat arrays: code points, and polynomial hashes of their prefixes."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.points)) - self.start[self.word]
        self.power = powers(int(self.length.max(initial=0)) + 1)

    def prefixes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every letter: the hash of what stands before it and of what goes up to it; and of every word its hash."""
        run = np.cumsum(values * self.power[self.place])
        base = np.concatenate([np.zeros(1, dtype=np.uint64), run])[self.start]
        upto = run - base[self.word]
        whole = np.concatenate([np.zeros(1, dtype=np.uint64), run])[self.start + self.length] - base
        return upto - values * self.power[self.place], upto, whole

    def parity(self) -> np.ndarray:
        """64 bits of every word: which letters, by their number modulo 64, occur an odd number of times. An edit changes two at most."""
        bits = np.left_shift(np.uint64(1), self.points & np.uint64(63))
        return np.bitwise_xor.reduceat(np.append(bits, np.uint64(0)), self.start) * (self.length > 0).astype(np.uint64)

    def deletions(self, values: np.ndarray) -> np.ndarray:
        """The hash of every word without each of its letters."""
        before, upto, whole = self.prefixes(values)
        return before + (whole[self.word] - upto) * np.uint64(INVERSE)

    def neighbours(self, values: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Word number and hash of the whole one-edit neighbourhood of every reduced word, itself included, each hash once."""
        before, upto, whole = self.prefixes(values)
        every = np.arange(1, symbols + 1, dtype=np.uint64)
        all_words = np.arange(len(whole))
        end = self.power[self.length]
        found = [
            (all_words, whole),
            (self.word, before + (whole[self.word] - upto) * np.uint64(INVERSE)),
            (np.repeat(self.word, symbols), (before + (whole[self.word] - upto))[:, None] + every * self.power[self.place][:, None]),
            (np.repeat(self.word, symbols), (before + (whole[self.word] - before) * np.uint64(BASE))[:, None] + every * self.power[self.place][:, None]),
            (np.repeat(all_words, symbols), whole[:, None] + every * end[:, None]),
        ]
        word, code = np.concatenate([w for w, _ in found]), np.concatenate([h.ravel() for _, h in found])
        order = np.lexsort((code, word))
        word, code = word[order], code[order]
        fresh = np.ones(len(word), dtype=bool)
        fresh[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
        return word[fresh], code[fresh]


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], letters: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with at most so many letters of `word`, or one row."""
    for b in batches:
        size = np.cumsum(np.fromiter((len(w) for w in b.column("word").to_pylist()), dtype=np.int64, count=b.num_rows))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + letters, side="right")))
            yield b.slice(at, end - at)
            at = end


def reduce_words(words: DataFrame, symbols: int) -> DataFrame:
    """word, n of words, with cls (the hash of the reduced spelling) and parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            s = Spellings(b.column("word").to_pylist())
            cls = s.prefixes(symbol_of(s.points, symbols))[2]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(_signed(cls)), pa.array(_signed(s.parity()))], names=["word", "n", "cls", "parity"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, cls long, parity long")


def reduced_neighbours(classes: DataFrame, symbols: int) -> DataFrame:
    """a, b: the class and each class of its one-edit neighbourhood whose number is not smaller; each pair of classes comes from one side.
    classes: cls, and word, any word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 40_000):
            s = Spellings(b.column("word").to_pylist())
            word, code = s.neighbours(symbol_of(s.points, symbols), symbols)
            a, other = b.column("cls").to_numpy()[word], _signed(code)
            keep = other >= a
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(other[keep])], names=["a", "b"])

    return classes.select("cls", "word").mapInArrow(run, "a long, b long")


def with_deletions(words: DataFrame) -> DataFrame:
    """The rows of words with v, the hashes of the word and of all that one deletion makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            s = Spellings(b.column("word").to_pylist())
            codes, whole = s.deletions(s.points), s.prefixes(s.points)[2]
            lists = [np.append(_signed(codes[i : i + n]), _signed(whole[j : j + 1])) for j, (i, n) in enumerate(zip(s.start, s.length, strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, type=pa.list_(pa.int64()))], names=[*b.schema.names, "v"])

    from pyspark.sql.types import ArrayType, LongType, StructType

    schema = StructType([*words.schema.fields]).add("v", ArrayType(LongType()))
    return words.mapInArrow(run, schema)


def near_words(words: DataFrame, symbols: int, crowd: int = 65_536) -> DataFrame:
    """a, n_a, b, n_b: each pair of distinct words that one inserted, deleted or replaced code point parts, once. words: distinct word, n.

    Pairs of classes with more than crowd pairs of words are not compared pair by pair: two words one edit apart share a string
    that at most one deletion makes of either, so within such a pair of classes they are joined on those, which is linear in the classes.
    """
    words = materialize(reduce_words(words, symbols))
    classes = materialize(words.groupBy("cls").agg(F.count("*").alias("size"), F.first("word").alias("word")))
    # Struct keys hide known partitionings, so both sides are shuffled and AQE may split a hot key.
    known = classes.select(F.struct(F.col("cls").alias("b")).alias("k"), F.col("size").alias("size_b"))
    met = reduced_neighbours(classes, symbols).select("a", F.struct("b").alias("k")).join(known, "k").select("a", F.col("k.b").alias("b"), "size_b")
    sizes = classes.select(F.struct(F.col("cls").alias("a")).alias("k"), F.col("size").alias("size_a"))
    met = materialize(met.select(F.struct("a").alias("k"), "b", "size_b").join(sizes, "k").select(F.col("k.a").alias("a"), "b", (F.col("size_a") * F.col("size_b")).alias("work")))

    def side(name: str, of: DataFrame) -> DataFrame:
        return of.select(F.struct(F.col("cls").alias(name)).alias("k"), F.struct("word", "n", "parity").alias(f"w{name}"))

    x, y = F.col("wa"), F.col("wb")
    once = (F.col("a") != F.col("b")) | (x["word"] < y["word"])
    alike = once & (F.bit_count(x["parity"].bitwiseXOR(y["parity"])) <= 2) & (F.levenshtein(x["word"], y["word"], 1) == 1)
    out = (x["word"].alias("a"), x["n"].alias("n_a"), y["word"].alias("b"), y["n"].alias("n_b"))

    light = met.filter(F.col("work") <= crowd).select(F.struct("a").alias("k"), "b").join(side("a", words), "k").select(F.struct("b").alias("k"), F.col("k.a").alias("a"), "wa")
    near = light.join(side("b", words).withColumn("b", F.col("k.b")), "k").filter(alike).select(*out)

    heavy = met.filter(F.col("work") > crowd).select("a", "b")
    crowded = heavy.select(F.col("a").alias("cls")).union(heavy.select("b")).distinct()
    rich = with_deletions(words.join(crowded, "cls", "left_semi"))

    def spread(name: str) -> DataFrame:
        of = rich.select(F.struct(F.col("cls").alias(name)).alias("k"), F.struct("word", "n", "parity").alias(f"w{name}"), "v")
        both = heavy.select(F.struct(name).alias("k"), "a", "b").join(of, "k")
        return both.select(F.explode("v").alias("v"), "a", "b", f"w{name}").select(F.struct("a", "b", "v").alias("k"), f"w{name}")

    shared = spread("a").join(spread("b"), "k").select(F.col("k.a").alias("a"), F.col("k.b").alias("b"), "wa", "wb")
    return near.union(shared.filter(alike).select(*out).distinct())


def alphabet_size(n_words: int) -> int:
    """How many symbols keep both the neighbourhoods and the classes of so many words small: classes number symbols to the
    power of the length, six letters or so, and neighbourhoods grow with the symbols."""
    return max(3, min(16, math.ceil(max(n_words, 1) ** (1 / 7))))


def follow_forms(forms: DataFrame) -> DataFrame:
    """word, root: what following forms leads to at last. forms: word, form, where no chain returns.

    Pointer jumping: every round each word takes its root's root, so rounds number the logarithm of the longest chain.
    """
    spark = forms.sparkSession
    at, path = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = at.select(F.struct(F.col("word").alias("root")).alias("k"), F.col("root").alias("next"))
        step = at.select("word", F.struct("root").alias("k")).join(jump, "k", "left")
        after, new = stored(step.select("word", F.coalesce("next", "k.root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not after.filter("moved").isEmpty()
        discard(spark, path)
        at, path = after.select("word", "root"), new
        if not moved:
            return at


def group_spellings(docs: DataFrame, shortest: int = 5, fewest: int = 3, ratio: int = 2, symbols: int | None = None, crowd: int = 65_536) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    n_near: how many words are one edit away. form: the most frequent of them (ties: the smallest in code-point order) if it occurs
    at least ratio times as often, else null; form_n its occurrences. root: where forms lead to, the word itself without one.
    Null and empty texts have no words, repeated rows count again, texts and words of any length are taken whole, and an
    empty table gives an empty result. Columns other than doc_id and text play no part.
    """
    words = materialize(vocabulary(letter_runs(docs), shortest, fewest))
    near = materialize(near_words(words, symbols or alphabet_size(words.count()), crowd))
    both = near.select("a", "b", F.col("n_b").alias("n")).union(near.select("b", "a", "n_a"))
    # The smallest of (-n, word) is the most frequent, then the first in code-point order.
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    judged = materialize(judged.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n")))
    roots = follow_forms(judged.filter("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
