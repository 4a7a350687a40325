"""Queries against their SQL on rows that the smallest tables do not hold."""

import datetime

import duckdb

from threadloom.plans import registry
from threadloom.sources import views


def both(spark, tmp_path, name, table, rows, schema):
    """Sorted rows of a query and of its SQL over one table of these rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_titles_keep_entities_as_they_are_written(spark, tmp_path):
    titles = ("a &quot;b&quot; &lt;c&gt;", "&amp;quot; &amp;amp; &AMP; & x", "it&#39;s&nbsp;&apos;", "")
    rows = [(i, f"https://h.example/{i}", f"<html><title> {t} </title></html>") for i, t in enumerate(titles)]
    got, want = both(spark, tmp_path, "r2_1_14_page_metadata", "pages", rows, "page_id long, url string, html string")
    assert got == want
    assert [r[1] for r in got] == ['a &quot;b&quot; &lt;c&gt;', "&quot; &amp; &AMP; & x", "it&#39;s&nbsp;&apos;", ""]


def test_packed_names_of_large_keys(spark, tmp_path):
    keys = [*range(1, 12), 9999, 10001, 99999, 123456, *range(999_995, 1_000_012), 1_200_001, 8_000_001, 10_000_001, 123_456_789, 10**15 + 1]
    got, want = both(spark, tmp_path, "r2_3_31_packed_evidence", "part", [(k, f"part {k}") for k in keys], "p_partkey long, p_name string")
    assert got == want


def test_text_exports_keep_whole_contents(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(i, at + datetime.timedelta(minutes=i), 1, "click", 0.0, "word " * (n // 5) + "x" * (n % 5)) for i, n in enumerate((2, 3994, 3996, 3997, 3999, 4001, 12_003, 250_002))]
    got, want = both(spark, tmp_path, "r2_1_8_text_exports", "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert got == want and len(got) == len(rows)


def test_messages_go_on_over_many_lines(spark):
    rows = [("p", 0, "2024-01-02 03:04 Ann: " + "a" * 5000), *[("p", i, "b" * 999) for i in range(1, 41)], ("p", 41, "2024-01-02 03:05 Bob: hi")]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    got = {r.sender: r.content for r in views.read_text_exports(lines).collect()}
    assert got == {"Ann": " ".join(["a" * 5000, *["b" * 999] * 40]), "Bob": "hi"}
