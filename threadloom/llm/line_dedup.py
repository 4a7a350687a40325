"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), at (first line of the window), w (two 64-bit hashes of its lines).

    Lines are cut at \\n and trimmed of white space; lines without a word are passed
    over, so a window may span them. Texts with fewer than width lines with a word have no window.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda l, i: F.struct(F.xxhash64(F.regexp_replace(l, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("h"), i.alias("i"), l.rlike(WORD).alias("word"))),
        lambda x: x["word"],
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), lines.alias("ls")).filter(F.size("ls") >= width)
    starts = F.sequence(F.lit(1), F.size("ls") - (width - 1))
    hashes = [F.element_at("ls", F.col("p") + k)["h"] for k in range(width)]
    flat = rows.select("doc_id", "th", "ls", F.explode(starts).alias("p"))
    return flat.select("doc_id", "th", F.element_at("ls", F.col("p"))["i"].alias("at"), F.array(*[F.element_at("ls", F.col("p") + k)["i"] for k in range(width)]).alias("covers"), F.xxhash64(*hashes).alias("h1"), F.xxhash64(F.lit(1), *hashes[::-1]).alias("h2"))


def repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th, gone: the line numbers that windows seen earlier cover, merged; documents with any only.

    The first occurrence of a window is the one with the smallest (doc_id, text hash, line), null
    doc_ids last; it stays. Each row is reduced per window before the shuffle, so a passage that
    many documents share is one row of the grouping; only its occurrences are joined back.
    """
    windows = materialize(line_windows(docs, width))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select(F.struct("h1", "h2").alias("w"), "first")
    later = windows.select(F.struct("h1", "h2").alias("w"), "covers", place.alias("place")).join(first.hint("merge"), "w").filter(F.col("place") > F.col("first"))
    return later.select("place.doc_id", "place.th", F.explode("covers").alias("line")).distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, width: int = 3, report: str = "line_dedup") -> DataFrame:
    """Columns of docs, with text without its repeated lines and n_chars to match (if there is one), then a struct
    with n_lines, n_removed and removed (line numbers), called `report`, with underscores added where docs has such
    a column.

    Rows that repeat a doc_id (or lack one) and its text count as one occurrence: they keep and lose
    the same lines. Null texts stay null. A text that loses all lines becomes empty; the row stays.
    """
    while report in docs.columns:
        report += "_"
    # Where many documents share lines, this side grows with the corpus; a merge join moves each text once at any size.
    gone = materialize(repeated_lines(docs, width)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "gone").hint("merge")
    row = docs.select(F.struct("*").alias("row"))
    both = row.join(gone, F.col("row.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("row.text") == F.col("__th")), "left")
    lines = F.split("row.text", "\n", -1)
    # A hash set of the lines to leave out would need a map; merged positions are sorted, so membership is cheap enough.
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: ~F.array_contains("gone", x["i"])), lambda x: x["l"]), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    done = both.select("row", text.alias("new"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))
    fields = {f.name: F.col(f"row.`{f.name}`") for f in docs.schema}
    fields["text"] = F.col("new")
    if "n_chars" in fields:
        fields["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return done.select(*[c.alias(n) for n, c in fields.items()], F.struct("n_lines", "n_removed", "removed").alias(report))


def keep_new_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs without repeated lines; a text that loses all of its lines has nothing left, and its row goes. Null and empty texts stay."""
    done = dedup_lines(docs, width)
    report = done.columns[-1]
    gone = (F.length(F.trim("text")) == 0) & (F.col(report)["n_removed"] > 0)
    return done.filter(~F.coalesce(gone, F.lit(False))).drop(report)
