"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text

WINDOW, WIDTHS, EMBED, FILTERS = 256, (2, 3, 4), 8, 16
STEP = WINDOW - max(WIDTHS) + 1  # windows overlap, so every byte n-gram lies within one
BLOCK = 64  # windows a matrix product


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def windows_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length byte windows over whole texts: (windows, text number of each, its bytes)."""
    raw = [t.encode().lower() for t in texts]
    need = [max(1, -(-max(len(r) - (WINDOW - STEP), 1) // STEP)) for r in raw]
    flat = np.zeros(sum(need) * STEP + WINDOW, dtype=np.uint8)
    owner, size = np.repeat(np.arange(len(raw)), need), np.empty(sum(need), dtype=np.float32)
    first = 0
    out = np.empty((sum(need), WINDOW), dtype=np.uint8)
    for r, n in zip(raw, need, strict=True):
        one = flat[: n * STEP + WINDOW - STEP]
        one[:] = 0
        one[: len(r)] = np.frombuffer(r, dtype=np.uint8)
        out[first : first + n] = np.lib.stride_tricks.sliding_window_view(one, WINDOW)[::STEP]
        size[first : first + n] = np.minimum(WINDOW, np.maximum(1, len(r) - STEP * np.arange(n)))
        first += n
    return out, owner, size


class ByteConvNet:
    """Byte embedding, filters of several widths, max over the window, softmax. Weights are plain arrays."""

    def __init__(self, classes: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.classes = classes
        self.embed = g.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((wide, EMBED, n), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, n)
        self.conv = (g.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(self.mask.sum(0))).astype(np.float32)
        self.bias = np.zeros(n, dtype=np.float32)
        self.out = g.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), dtype=np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        v = np.lib.stride_tricks.as_strided(e, (len(x), STEP, max(WIDTHS) * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(v).reshape(-1, max(WIDTHS) * EMBED)

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), dtype=np.float32)
        for i in range(0, len(x), BLOCK):
            b = x[i : i + BLOCK]
            a = (self._columns(b) @ self.conv).reshape(len(b), STEP, -1).max(1)
            out[i : i + BLOCK] = self._softmax(np.maximum(a + self.bias, 0))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy. The gradient of a max goes to its argmax only, so the way back is cheap."""
        g = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "out_bias")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step, wide = 0, max(WIDTHS)
        for _ in range(epochs):
            order = g.permutation(len(x))
            for i in range(0, len(x), BLOCK):
                b, t = x[order[i : i + BLOCK]], y[order[i : i + BLOCK]]
                cols = self._columns(b)
                a = (cols @ self.conv).reshape(len(b), STEP, -1)
                top = a.argmax(1)
                pre = np.take_along_axis(a, top[:, None], 1)[:, 0] + self.bias
                h = np.maximum(pre, 0)
                d = self._softmax(h)
                d[np.arange(len(b)), t] -= 1
                d /= len(b)
                dh = (d @ self.out.T) * (pre > 0)
                rows = np.arange(len(b))[:, None] * STEP + top
                picked = cols[rows]  # window, filter, width * embedding
                grad = {"out": h.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0), "conv": np.einsum("bf,bfk->kf", dh, picked) * self.mask}
                back = (dh[:, :, None] * self.conv.T[None]).reshape(-1, wide, EMBED)
                at = (top[:, :, None] + np.arange(wide)).reshape(len(b), -1)
                de = np.zeros_like(self.embed)
                np.add.at(de, np.take_along_axis(b, at, 1).reshape(-1), back.reshape(-1, EMBED))
                de[0] = 0
                grad["embed"] = de
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))


def train(docs: DataFrame, per_language: int = 1200, windows_each: int = 2) -> ByteConvNet | None:
    """A network learned from a bounded sample: at most per_language documents of every language, windows_each windows
    of each, spread over its text.

    Documents are drawn by a hash of doc_id and text. Rows that repeat both are one document, drawn once, so every language is
    drawn from however often its documents are repeated.
    Only text and lang of rows with both that are not held out are used. The driver gets the windows drawn, which the
    two bounds and the number of languages limit. None if there are no such rows.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    # Counts only set the share to draw: one row per language.
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None

    def make():
        def run(texts: list) -> dict:
            x, owner, _ = windows_of(texts)
            first = np.searchsorted(owner, np.arange(len(texts)))
            many = np.bincount(owner, minlength=len(texts))
            picked = lambda f, n: [x[f + j * n // windows_each].tobytes() for j in range(min(windows_each, n))]
            return {"windows": [picked(f, n) for f, n in zip(first, many, strict=True)]}

        return run

    # A little over per_language documents each; all of them where there are no more.
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.1 * per_language / n)))])
    some = rows.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    once = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = Window.partitionBy("lang").orderBy("h", "windows")
    got = map_text(once, make, "windows array<binary>", keep=("lang", "h"))
    got = got.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= per_language).orderBy("h", "lang", "windows").toArrow()
    classes, x, y = sorted(counts), [], []
    for lang, windows in zip(got["lang"].to_pylist(), got["windows"].to_pylist(), strict=True):
        x += windows
        y += [classes.index(lang)] * len(windows)
    net = ByteConvNet(classes)
    net.fit(np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep + lang_pred, score: the windows' probabilities, averaged by their bytes over the whole text.

    Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned.
    """

    def make():
        def run(texts: list) -> dict:
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
            part: list[int] = []
            size = 0
            for i in [*rows, None]:
                if i is None or size > 2_000_000:
                    if part:
                        x, owner, w = windows_of([texts[k] for k in part])
                        p = net.predict(x).astype(np.float64) * w[:, None]
                        total = np.add.reduceat(p, np.searchsorted(owner, np.arange(len(part))))
                        total /= total.sum(1, keepdims=True)
                        for k, q in zip(part, total, strict=True):
                            lang[k], score[k] = net.classes[int(q.argmax())], float(min(1.0, q.max()))
                    part, size = [], 0
                if i is not None:
                    part.append(i)
                    size += len(texts[i])
            return {"lang_pred": lang, "score": score}

        return run

    return map_text(docs, make, "lang_pred string, score double", keep, text)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; rows that repeat a doc_id are predicted each.

    A null doc_id is never held out. An empty table gives an empty result.
    """
    net = train(docs, **bounds)
    got = predict(docs, net)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """Rows of docs whose language is found with a score of least or more; `und` goes. Columns are those of docs."""
    net = train(docs, **bounds)
    got = predict(docs.select(F.struct("*").alias("row")), net, ("row",), "row.text")
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
