"""Value candidates file by file, and samples of tables by hash order."""

import re

from pyspark.sql import functions as F

from threadloom.operators import library, reports

FILES = [
    # path, relative path, size, sha, modified: what becomes of it
    ("C:\\Tencent Files\\1\\FileRecv\\a.png", "a.png", 10, "1", 1, (46, "medium", "review")),
    ("C:\\x\\课程\\plan.pdf", "课程\\plan.pdf", 2_000_000, "2", 1, (79, "high", "archive_candidate")),
    ("C:\\x\\plan.zip", "plan.zip", 10, "3", 1, (57, "medium", "archive_candidate")),
    ("C:\\x\\notes.txt", "notes.txt", 5000, "4", 1, None),  # 12: too little
    ("C:\\课程\\notes.txt", "课程\\notes.txt", 5000, "5", 1, (42, "medium", "review")),
    ("C:\\x\\cache\\b.pdf", "b.pdf", 10, "6", 1, None),  # noise
    ("C:\\x\\cache\\课程.pdf", "课程.pdf", 10, "7", 1, (45, "medium", "archive_candidate")),
    ("C:\\x\\empty.pdf", "empty.pdf", 0, "8", 1, None),
    ("C:\\x\\held.pdf", "held.pdf", 9, "h", 1, None),  # by hash
    ("C:\\X\\OLD.pdf", "OLD.pdf", 9, "9", 1, None),  # by path
    ("C:\\Tencent Files\\Image\\pic_720.jpeg", "pic.jpeg", 9, "10", 1, None),  # another size of an archived picture
    ("C:\\x\\twice(1).pdf", "twice(1).pdf", 9, "11", 1, None), ("C:\\y\\twice.pdf", "twice.pdf", 9, "12", 2, (45, "medium", "archive_candidate")),
    ("C:\\WXWork\\c.docx", "c.docx", 9, "13", 1, (49, "medium", "archive_candidate")),
    ("C:\\AppData\\Roaming\\QQ\\cache\\课程.pdf", "课程.pdf", 7, "14", 1, None), ("C:\\x\\x.dat", "x.dat", 9, "15", 1, None), (None, None, None, None, None, None),
]


def test_every_rule(spark):
    df = spark.createDataFrame([(*f[:5],) for f in FILES], "path string, relative_path string, size long, sha256 string, modified long")
    old = spark.createDataFrame([("c:\\x\\old.PDF", "z"), ("D:\\o\\k.bin", "h"), ("D:\\o\\pic_0.jpg", "p")], "path string, sha256 string")
    got = {r["path"]: (r["score"], r["level"], r["action"]) for r in library.scored_candidates(df, old).collect()}
    assert got == {f[0]: f[5] for f in FILES if f[5]}
    best = library.value_candidates(df, old, 2).collect()
    assert [r["score"] for r in best] == [79, 57] and best[0]["reasons"] == ["文档/表格/压缩包", "路径命中价值关键词", "文件体积较大"] and best[0]["bucket"] == "学业"
    assert library.candidate_totals(library.value_candidates(df, old)).agg(F.sum("files")).first()[0] == len(got)


def test_samples_by_hash_order(spark):
    import itertools

    rows = [(i, f"value {i}\n {'会议' * (i % 2)} http", None if i % 3 else "x", b"raw") for i in range(200)] + [(999, None, "y", None)]
    df = spark.createDataFrame(rows, "id long, title string, memo string, content binary")
    r = reports.profile_tables(spark, {"chat_log": df.repartition(7), "plain": df.select("id")}).collect()
    row, plain = r[0], r[1]
    assert (row["rows"], row["columns"], row["focus"], row["suspected_message"]) == (201, 4, "其他结构化数据", False) and plain["samples"] == []
    values = sorted({re.sub(r"\s+", " ", t).strip() for _, t, *_ in rows if t})
    hashes = spark.createDataFrame([(v, k) for v, k in itertools.product(values, range(8))], "v string, k int").select("v", "k", F.xxhash64("k", "v").alias("h")).collect()
    least = [min((x["h"], x["v"]) for x in hashes if x["k"] == k)[1] for k in range(8)]
    want = [v for v in dict.fromkeys(least) if len(v) >= 2][:4]
    assert [s["value"] for s in row["samples"] if s["column"] == "title"] == want
    assert all(s["signals"] == (["链接", "会议/日程"] if "会议" in s["value"] else ["链接"]) for s in row["samples"] if s["column"] == "title")
    # The table's own name says text, so its numbers are shown too; values of one character and bytes are not.
    assert {s["column"] for s in row["samples"]} == {"title", "id"}
    assert reports.profile_tables(spark, {"t": df.limit(0)}).first()["samples"] == []
