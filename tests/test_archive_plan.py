"""Archive plans against one candidate at a time, on a thousand random plans at once, and the rules that the library's files follow."""

import random

import duckdb
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.operators import assets, library
from threadloom.plans import registry


def suffixed(path, sha):
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if stem else (name, "")
    return f"{folder}/{stem}-{sha[:8]}{ext}"


def one_by_one(previous, cands, existing):
    there = {p.lower(): s for p, s in existing}
    recorded, known, issues = {}, {}, []
    for s, p in sorted(previous, key=lambda x: x[1]):
        known.setdefault(s, p)
        if p.lower() not in there:
            issues.append(("missing-previous-copy", p, s, None))
        elif there[p.lower()] != s:
            issues.append(("changed-previous-copy", p, s, there[p.lower()]))
        recorded[p.lower()] = s
    at = {**recorded, **there}
    out = {}

    def clash(p, s):
        k = p.lower()
        return k in recorded and recorded[k] != s or k in at and at[k] != s

    for i, s, target in cands:
        if s in known:
            out[i] = ("reuse", known[s])
            continue
        p = suffixed(target, s) if clash(target, s) else target
        if clash(p, s):
            out[i] = ("conflict", p)
            issues.append(("target-conflict", p, s, at.get(p.lower(), recorded.get(p.lower()))))
            continue
        out[i] = ("reuse_copy" if p.lower() in at else "copy", p)
        known[s] = p
        recorded[p.lower()] = at[p.lower()] = s
    return out, issues


def test_a_thousand_plans_equal_one_by_one(spark):
    """Few names in two cases and few hashes that share their first eight digits, so that targets, suffixes and earlier paths clash."""
    rng = random.Random(11)
    prev, cands, have, want, issues = [], [], [], {}, []
    for plan in range(1000):
        sha = lambda: f"{plan:04}{rng.choice('ab')}xyz{rng.randrange(5)}"  # noqa: B023, E731
        path = lambda: f"/{plan}/" + rng.choice(["n.txt", "N.txt", "m", f"n-{plan:04}axyz.txt", f"N-{plan:04}bxyz.txt", "k.tar.gz"])  # noqa: B023, E731
        p = list({x[1].lower(): x for x in ((sha(), path()) for _ in range(rng.randrange(3)))}.values())
        h = list({x[0].lower(): x for x in ((path(), sha()) for _ in range(rng.randrange(3)))}.values())
        c = [(plan * 100 + i, sha(), path()) for i in range(rng.randrange(12))]
        prev, have, cands = prev + p, have + h, cands + c
        got, wrong = one_by_one(p, c, h)
        want |= got
        issues += wrong
    frames = (spark.createDataFrame(prev, "sha256 string, archive_path string"), spark.createDataFrame(cands, "file_id long, sha256 string, target string"), spark.createDataFrame(have, "archive_path string, sha256 string"))
    plan = library.plan_archive(*frames).cache()
    assert {r["file_id"]: (r["action"], r["archive_path"]) for r in plan.collect()} == want and plan.count() == len(cands)
    assert sorted(map(repr, map(tuple, library.archive_issues(frames[0], frames[2], plan).collect()))) == sorted(map(repr, issues))
    assert {a for a, _ in want.values()} == {"copy", "reuse", "reuse_copy", "conflict"} and {k for k, *_ in issues} == {"missing-previous-copy", "changed-previous-copy", "target-conflict"}


def test_plans_of_nothing_and_of_copies(spark):
    p, h = spark.createDataFrame([("h0", "/Arc/old.pdf")], "sha256 string, archive_path string"), spark.createDataFrame([], "archive_path string, sha256 string")
    c = spark.createDataFrame([(i, "same", "/Arc/F.pdf") for i in range(300)] + [(400, "h3", "\\Arc\\OLD.pdf"), (401, None, "/x"), (402, "h4", None), (403, "h5", "./arc/f.pdf")], "file_id long, sha256 string, target string")
    got = {r["file_id"]: (r["action"], r["archive_path"]) for r in library.plan_archive(p, c, h).collect()}
    assert got[0] == ("copy", "/Arc/F.pdf") and all(got[i] == ("reuse", "/Arc/F.pdf") for i in range(1, 300))
    assert got[400] == ("copy", "/Arc/OLD-h3.pdf") and got[401] == got[402] == ("skip", None) and got[403] == ("copy", "arc/f.pdf")
    assert library.plan_archive(p, c.limit(0), h).count() == 0


def test_the_query_equals_its_sql_where_hashes_share_eight_digits(spark, tmp_path):
    """Two texts whose hashes open with b30a892c under one name that is taken, a later copy of the second under a free name, and what comes after it there."""
    texts = {1: "first", 2101: "text 859", 4201: "text 4460", 4204: "text 4460", 6304: "another", 8404: "text 4460", 10504: "one more"}
    rows = [(i, t, "en", "src1", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["r2_13_3_plan_archive"]).fetchall()
    got = registry.QUERIES["r2_13_3_plan_archive"](spark, str(tmp_path)).select("file_id", "sha256", "action", "archive_path").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[3] for r in want if r[0] in (2101, 4201)}) == 1
    actions = {r["file_id"]: r["action"] for r in library.plan_archive(*registry.q_library.archive_inputs(spark, str(tmp_path))).collect()}
    assert actions == {1: "copy", 2101: "copy", 4201: "conflict", 4204: "copy", 6304: "copy", 8404: "reuse", 10504: "copy"}


def test_media_variants(spark):
    names = {"/a/p_0.jpg": "p.jpg", "C:\\x\\P.JPEG": "p.jpg", "/a/p_1080.mp4": "p.mp4", "/a/p_999.png": "p_999.png", "/a/scan_2024.pdf": "", "/a/b_480": "", "q_720.Amr": "q.amr"}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r["path"]: r["k"] for r in df.select("path", rules.media_variant_key(F.col("path")).alias("k")).collect()} == names
    files = spark.createDataFrame([("/n/scan_2024.pdf", "s1"), ("/n/p_0.jpg", "s2"), ("/n/new.png", "s3")], "path string, sha256 string")
    old = spark.createDataFrame([("/o/scan_2023.pdf", "t1"), ("/o/p.jpeg", "t2")], "path string, sha256 string")
    assert {r["path"] for r in library.unarchived(files, old).collect()} == {"/n/scan_2024.pdf", "/n/new.png"}


def test_artifact_categories(spark):
    cases = [
        ("a.pptx", None, None, False, False, "document"), ("a.png", None, "http://x", False, False, "work"), ("a.html", None, None, False, True, "work"), ("my_skills.txt", None, None, False, False, "skill"),
        ("x", " Skill ", None, False, False, "skill"), ("x", "sheet", None, False, False, "document"), ("x", None, " ", True, True, "work"), ("x", None, "http://x", False, True, "link"), ("x", None, " ", False, True, "chatText"),
        (None, None, None, None, None, "work"), ("技能包.bin", None, None, False, False, "skill"), ("skillful.bin", None, None, False, False, "work"),
    ]
    df = spark.createDataFrame(cases, "name string, preview string, url string, local boolean, chat boolean, want string")
    got = df.select("want", assets.artifact_category(*map(F.col, ("name", "preview", "url", "local", "chat"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
