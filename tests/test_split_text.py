"""Texts cut by regular expressions against the fold over their characters."""

import random

from pyspark.sql import functions as F

from threadloom.functions import scalars


def test_pieces_equal_the_fold_over_characters(spark):
    g = random.Random(4)
    pool = ["a", "é", " ", "\n", "汉", "字", "😀", "©", "®", "☀", "、", " ", "𠀀", "𝒳"]
    texts = ["", None, "a" * 500, "汉" * 50, "汉" + "a" * 81, "a" * 79 + "汉", "a" * 77 + "汉a", "x" * 30 + "￿" + "汉" * 30, "￿" * 90]
    texts += ["".join(g.choices(pool, weights=[g.random() ** 3 for _ in pool], k=g.randrange(300))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 2, 7, 20):
        fast, slow = scalars.split_text(F.col("t"), most), scalars._split_each(F.col("t"), most)
        assert df.select(fast.alias("p"), slow.alias("q")).filter("NOT (p <=> q)").count() == 0
    heavy = F.length(F.regexp_replace("t", f"[^{scalars.HEAVY}]", ""))
    assert df.filter(~scalars.search_tokens(F.col("t")).eqNullSafe(F.ceil(heavy + (F.length("t") - heavy) * 0.25))).count() == 0


def test_light_texts_are_not_folded(spark):
    """A text of one million characters is cut in linear time, which the fold's growing strings are not."""
    df = spark.range(1).select(F.repeat(F.lit("abcde fghi"), 100_000).alias("t"))
    row = df.select(scalars.split_text(F.col("t"), 20).alias("p")).select(F.size("p").alias("n"), F.array_join("p", "").alias("all"), "p").first()
    assert row["n"] == 12_500 and len(row["all"]) == 1_000_000 and set(map(len, row["p"])) == {80}
