"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize

#: Bytes that end a word; letters beyond ASCII stay.
BREAK = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x27 else 0x20 for c in range(256))
SHAPES = 6


PREFIXES = (4, 5, 6)


def words_of(text) -> set[bytes]:
    """The words of a text, lower-cased, and the beginnings of its longer ones, marked `^`: inflected and invented forms share these."""
    words = set((text or "").encode().lower().translate(BREAK).split())
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))


def shape_of(text, words: set) -> list[float]:
    """Features that no word carries: capitals, marks, columns, digits, variety, length."""
    text = text or ""
    n = max(1, len(text))
    tokens = max(1, len(text.split()))
    marks = [min(1.0, 5 * text.count(c) / n) for c in "!|"]
    return [
        sum(map(str.isupper, text)) / n, *marks, sum(map(str.isdigit, text)) / n,
        min(1.0, len(words) / (4 * tokens)), np.log1p(tokens) / 10,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        d = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += d
        if np.abs(d).max() < 1e-3:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def present(words: set[bytes], index: dict[bytes, int], row: np.ndarray) -> None:
    """Sets row to 1 at the places of those words that index knows."""
    for w in index.keys() & words:
        row[index[w]] = 1


class Chain:
    """Linear models in order; each also sees the probabilities that those before it gave.

    In training those are out-of-fold: a row's earlier probabilities come from a model, and from a vocabulary, that
    never saw its fold, as a model is too sure of rows it was fitted on, and the later one would learn to
    lean on that. In use they come from the models fitted on all rows.
    """

    def __init__(self, categories: list[str], vocabulary: list[bytes]):
        self.categories, self.index = categories, {w: i for i, w in enumerate(vocabulary)}
        self.weights: list[np.ndarray] = []

    def features(self, texts: list) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index) + SHAPES))
        for r, t in enumerate(texts):
            words = words_of(t)
            present(words, self.index, x[r])
            x[r, len(self.index) :] = shape_of(t, words)
        return x

    def fit(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, fold_x: list[np.ndarray], ridge: float = 0.2) -> None:
        """x: features of the training rows. fold: their fold numbers; fold_x: their features by each fold's vocabulary,
        which was chosen without that fold. A fold that holds all rows or none leaves the prior as their probability."""
        earlier = np.zeros((len(x), 0))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            self.weights.append(fit_logistic(np.hstack([x, earlier]), y, ridge))
            out = np.full(len(x), (y.sum() + 1) / (len(y) + 2))
            for f, own in enumerate(fold_x):
                inside, seen = fold != f, np.hstack([own, earlier])
                if inside.any() and not inside.all():
                    out[~inside] = chance(logits(seen[~inside], fit_logistic(seen[inside], y[inside], ridge)))
            earlier = np.hstack([earlier, out[:, None]])

    def predict(self, texts: list) -> np.ndarray:
        x = self.features(texts)
        for _ in self.weights:
            w = self.weights[x.shape[1] - len(self.index) - SHAPES]
            x = np.hstack([x, chance(logits(x, w))[:, None]])
        return x[:, len(self.index) + SHAPES :]


def telling_words(words: DataFrame, folds: int, categories: int, size: int, least: int, z_least: float = 4.0) -> list[list[bytes]]:
    """For each fold, from the texts outside it, and last for all texts: the words and beginnings most over-represented
    with any category by their z score. words: fold, y (array of int), words. At most size words a list reach the driver."""
    each = words.select("fold", "y", F.explode("words").alias("w"))
    label = lambda k: F.col("y")[k]

    def counts(f: int) -> list[Column]:
        outside = F.lit(1) if f == folds else F.when(F.col("fold") != f, 1).otherwise(0)
        return [F.sum(outside).alias(f"n{f}"), *[F.sum(outside * label(k)).alias(f"c{f}_{k}") for k in range(categories)]]

    parts = [c for f in range(folds + 1) for c in counts(f)]
    totals = words.agg(*parts).first()
    per = materialize(each.groupBy("w").agg(*parts).filter(F.col(f"n{folds}") >= least))
    out = []
    for f in range(folds + 1):
        n = F.col(f"n{f}")
        rates = [(totals[f"c{f}_{k}"] or 0) / max(1, totals[f"n{f}"] or 0) for k in range(categories)]
        scores = [(F.col(f"c{f}_{k}") - n * r) / F.sqrt(n * (r * (1 - r)) + 1e-9) for k, r in enumerate(rates)]
        z = F.greatest(*scores) if len(scores) > 1 else scores[0]
        best = per.filter(n >= least).select("w", z.alias("z")).filter(F.col("z") > z_least).orderBy(F.desc("z"), "w")
        out.append([bytes(r["w"]) for r in best.limit(size).collect()])
    return out


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = 6000, words: int = 256, least: int = 4, folds: int = 5
) -> Chain | None:
    """A chain over categories (name -> boolean Column of labels, in order), fitted on the max_rows labelled documents
    of the smallest hash. Texts that agree but for case and white space count as one and train once, so that a
    copied text does not make its words look toxic; of labels that differ the largest counts. Rows that repeat
    in either table change nothing. Words and features are taken on the executors: the driver gets max_rows rows of
    numbers. None if no labelled text is found; null ids, texts and labels teach nothing.
    """
    marks = F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in categories.values()])
    drawn = labels.select("doc_id", marks.alias("y")).filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    plain = F.xxhash64(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    rows = docs.select("doc_id", "text", plain.alias("th")).filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # max_rows rows
    once = rows.groupBy("th").agg(F.max("y").alias("y"), F.min("text").alias("text")).orderBy("th").limit(max_rows)
    once = materialize(once.withColumn("fold", F.pmod("th", F.lit(folds)).cast("int")))
    many = len(categories)

    def taken() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            got = [words_of(t) for t in texts]
            return {"words": [list(w) for w in got], "shape": [shape_of(t, w) for t, w in zip(texts, got, strict=True)]}

        return run

    held = materialize(map_text(once, taken, "words array<binary>, shape array<double>", ("th", "y", "fold")))
    lists = telling_words(held, folds, many, words, least)
    union = sorted(set().union(*lists))
    place = {w: i for i, w in enumerate(union)}

    def marked(batches):
        for b in batches:
            seen = [[place[w] for w in place.keys() & set(ws)] for ws in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("th", "y", "fold", "shape")), pa.array(seen, pa.list_(pa.int32()))], names=["th", "y", "fold", "shape", "at"])

    got = held.mapInArrow(marked, "th long, y array<int>, fold int, shape array<double>, at array<int>").orderBy("th").toArrow()  # max_rows
    if not got.num_rows:
        return None
    y, fold, shape = (np.array(got[c].to_pylist()) for c in ("y", "fold", "shape"))
    x = np.zeros((len(y), len(union)))
    for r, at in enumerate(got["at"].to_pylist()):
        x[r, at] = 1
    by = [np.hstack([x[:, [place[w] for w in some]], shape]) for some in lists]
    chain = Chain(list(categories), lists[-1])
    chain.fit(by[-1], y.reshape(len(y), many), fold, by[:-1])
    return chain


def score_toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.4) -> DataFrame:
    """doc_id, one probability per category of the chain (p_<name>), flagged (the last one reaches threshold).

    Whole texts are read. Null and empty texts have no words; they are scored by their
    shape alone and never flagged. Rows that repeat are scored each. An empty table gives an empty result.
    Without a chain there are no probabilities and nothing is flagged.
    """
    names = [f"p_{c}" for c in (chain.categories if chain else [])]

    def make():
        def run(texts: list) -> dict:
            p = chain.predict(texts) if chain else np.zeros((len(texts), 0))
            flag = [bool(t and q.size and q[-1] >= threshold) for t, q in zip(texts, p, strict=True)]
            return {n: p[:, i] for i, n in enumerate(names)} | {"flagged": flag}

        return run

    return map_text(docs, make, ", ".join([f"{n} double" for n in names] + ["flagged boolean"]))
