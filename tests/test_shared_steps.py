"""Steps that many columns name are worked out once: their patterns stand in the plan no more often than written."""

from pyspark.sql import functions as F

from threadloom.functions import rules, scalars, urls
from threadloom.operators import library
from threadloom.sources import views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_cut_once(spark):
    df = spark.createDataFrame([("http://a.b/x",)], "u string").select(urls.canonical_url(F.col("u")).alias("c"))
    assert plan(df).count("(https?)") == 5


def test_texts_are_stripped_once(spark):
    docs = spark.createDataFrame([(1, "<b>the  cat</b>\n and 12")], "doc_id long, text string")
    df = library.source_text_index(docs, rules.LATIN_SIGNALS)
    assert plan(df).count("script|style") == 1 and plan(df).count("the|der|la") == 1
    assert df.first().asDict() == {"doc_id": 1, "signals": "article|link|number", "quality": "low", "excerpt": "the cat and 12"}


def test_single_spaces(spark):
    texts = ["", None, " a  b ", "a\n\tb", "a \n", "\n a", "x\x0b\f\ry", "a\u00a0 b", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~scalars.single_spaced(F.col("t")).eqNullSafe(F.regexp_replace("t", r"\s+", " "))).count() == 0


def test_line_forms_are_told_once(spark):
    lines = spark.createDataFrame([("p", 1, " [2024-01-02 03:04:05] ann: hello ")], "path string, line_no long, line string")
    df = views.read_text_exports(lines)
    assert plan(df).count("RLIKE " + views.LINES[0][0]) <= 1
    assert [tuple(r) for r in df.collect()] == [("p", 1, "2024-01-02 03:04:05", "ann", "hello")]
