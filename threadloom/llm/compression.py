"""Quality rules by compression: zstandard ratios within bands that depend on length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize

#: (whole bytes from, least ratio, most ratio): limits that hold whatever the corpus looks like. A ratio is raw bytes
#: over compressed bytes at LEVEL. Below the least a text is noise, above the most it repeats itself. Texts of under
#: SHORT bytes hardly compress and are not judged.
OUTER, SHORT = ((0, 0.0, 3.5), (256, 1.1, 3.0), (1024, 1.3, 3.2), (4096, 1.5, 3.6), (32768, 1.6, 4.5)), 256
#: The same for fixed chunks of CHUNK bytes; a text fails if over half of its chunks lie outside.
CHUNK, CHUNK_OUTER = 4096, (1.3, 4.0)
LEVEL = 3
SYMBOLS = "#*$%&|<>"
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, chunk_ratios array<double>"
)


def measures_maker(chunk: int = CHUNK, level: int = LEVEL):
    def make():
        import numpy as np
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=level).compress
        drop = str.maketrans("", "", SYMBOLS)
        spaces = str.maketrans("", "", " \t\n\v\f\r")

        def repeated(words: list) -> int:
            n = len(words)
            if n < 4:
                return 0
            ids: dict = {}
            w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
            v = len(ids)
            if v == n:
                return 0
            # Exact codes while v^3 fits; beyond 2 million different words pairs are numbered first.
            pair = w[:-1] * v + w[1:]
            if v >= 2_000_000:
                pair = np.unique(pair, return_inverse=True)[1]
            code = pair[:-1] * v + w[2:]
            order = np.argsort(code, kind="stable")
            same = np.diff(code[order]) == 0
            if not same.any():
                return 0
            twice = np.zeros(len(code), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : k + len(code)] |= twice
            return int(covered.sum())

        def one(text) -> tuple:
            text = text or ""
            raw = text.encode()
            words = raw.split()
            n = len(words)
            chars = len(text.translate(spaces))
            symbols = len(text) - len(text.translate(drop))
            seen, dup = set(), 0
            for line in raw.split(b"\n"):
                if line in seen:
                    dup += bool(line.split(None, 1))
                else:
                    seen.add(line)
            rep = repeated(words)
            failed = n < 50 or 100 * rep > 50 * n
            ratio = len(raw) / len(zip_(raw)) if raw else 0.0
            # The last chunk is the last `chunk` bytes, so no byte of a long text goes unmeasured.
            at = [*range(0, len(raw) - chunk, chunk), len(raw) - chunk] if len(raw) > chunk else []
            parts = [chunk / len(zip_(raw[i : i + chunk])) for i in at]
            return n, chars, symbols, dup, rep, failed, len(raw), ratio, parts

        names = [f.split()[0] for f in FIELDS.split(", ")]
        return lambda texts: dict(zip(names, zip(*map(one, texts)) if texts else [[]] * len(names), strict=True))

    return make


def length_class(n_bytes: Column) -> Column:
    """Half an octave of length is one class: 2 log2 of the bytes, rounded down."""
    return F.floor(2 * F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))).cast("int")


def _fences(values: DataFrame, by: str, factor: float, least_spread: float) -> DataFrame:
    """by, n, low, high: the median less and plus factor times the spread, from the quartiles of `value` in each group.

    values: by, value, each different text once. The spread on a side is what the distance of its quartile would be
    as a standard deviation, least_spread of the median at least. Values are rounded to 0.001, so percentiles are
    counted exactly in little memory and do not depend on the order of rows.
    """
    q = F.percentile(F.round("value", 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = values.groupBy(by).agg(F.count("*").alias("n"), q.alias("q"))
    mid, floor = F.col("q")[1], F.col("q")[1] * least_spread
    side = lambda x: factor * F.greatest(F.abs(x - mid) / 0.6745, floor)
    return got.select(by, "n", (mid - side(F.col("q")[0])).alias("low"), (mid + side(F.col("q")[2])).alias("high"))


def fit_bands(measured: DataFrame, factor: float = 6.0, least_spread: float = 0.025, enough: int = 100) -> tuple[dict, tuple]:
    """({length class: (low, high)}, (low, high) of chunks), from the texts that pass the base rule.

    Copies of a text count once (texts of one length and ratio are taken for copies), so a text with thousands of
    them does not set the limits. Classes of fewer than `enough` texts and chunks if there are fewer have no band.
    The driver gets one row per half octave of length.
    """
    good = measured.filter("NOT base_failed")
    texts = good.select(length_class(F.col("n_bytes")).alias("class"), "n_bytes", F.col("ratio").alias("value")).distinct()
    per = _fences(texts.select("class", "value"), "class", factor, least_spread).filter(F.col("n") >= enough).collect()
    once = good.filter(F.size("chunk_ratios") > 0).dropDuplicates(["n_bytes", "ratio"])
    parts = once.select(F.lit(0).alias("all"), F.explode("chunk_ratios").alias("value"))
    chunks = _fences(parts, "all", factor, least_spread).filter(F.col("n") >= enough).collect()
    return {r["class"]: (r["low"], r["high"]) for r in per}, (chunks[0]["low"], chunks[0]["high"]) if chunks else CHUNK_OUTER


def limits_of(bands: dict[int, tuple], length_classes: int = 128) -> list[tuple[float, float]]:
    """Limits for each class, within OUTER. Ratios rise with length, so a class without a band takes the low limit
    of the next shorter class that has one and the high limit of the next longer one, and OUTER where there is none."""
    out = []
    for c in range(length_classes):
        least, most = next((lo, hi) for n, lo, hi in reversed(OUTER) if 2 ** ((c + 1) / 2) > n)
        low = next((bands[k][0] for k in range(c, -1, -1) if k in bands), least)
        high = next((bands[k][1] for k in range(c, length_classes) if k in bands), most)
        out.append((max(low, least), min(high, most)))
    return out


def compression_quality(docs: DataFrame, chunk: int = CHUNK, level: int = LEVEL, short: int = SHORT, **fit) -> DataFrame:
    """doc_id, the base counts and verdict, kept, and what the method measured: ratio, its limits, bad_chunks, chunks.

    kept is false if the base rule fails, if the ratio of the whole text lies outside the limits of its
    length, or if over half of its chunks lie outside theirs. Limits come from the corpus itself (fit_bands); texts of
    under `short` bytes pass. Texts longer than a chunk have chunks, the last one being the last `chunk` bytes.
    A null or empty text has no words and fails the base rule. Rows that repeat are measured each and count once for
    the limits. An empty table gives an empty result, and in a table of few texts only the outer limits hold.
    """
    measured = materialize(map_text(docs, measures_maker(chunk, level), FIELDS))
    bands, (chunk_low, chunk_high) = fit_bands(measured, **fit)
    limits = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in limits_of(bands)])
    own = F.element_at(limits, length_class(F.col("n_bytes")) + 1)
    within = (max(chunk_low, CHUNK_OUTER[0]), min(chunk_high, CHUNK_OUTER[1]))
    bad = F.size(F.filter("chunk_ratios", lambda r: ~r.between(*within)))
    found = measured.withColumns({"own": own, "bad_chunks": bad, "chunks": F.size("chunk_ratios")})
    inside = (F.col("n_bytes") < short) | F.col("ratio").between(F.col("own.lo"), F.col("own.hi"))
    kept = ~F.col("base_failed") & inside & (2 * F.col("bad_chunks") <= F.col("chunks"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    shown = [F.col("own.lo").alias("low"), F.col("own.hi").alias("high")]
    return found.select("doc_id", *counts, kept.alias("kept"), "n_bytes", "ratio", *shown, "bad_chunks", "chunks")
