"""Archive operators on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import rules, scalars, urls
from threadloom.operators import assets, audit, canonical, insights, library, reports, search, sinks, timeline
from threadloom.sources import views

MSG = "conv_id string, source_db string, source_adapter string, local_id long, server_id string, occurred_at_epoch_s long, source_sort_seq long, raw_type long, sender string, text string"
ROWS = [
    ("c", "message_0.db", "regular", 1, "1001", 1700000000, 10, 1, "a", "one"), ("c", "biz_message_0.db", "biz", 1, "1003", 1700000000, 15, 1, "b", "two"),
    ("c", "message_0.db", "regular", 2, "1002", 1700000000, 40, 1, "a", "same"), ("c", "message_1.db", "regular", 7, "1002", 1700000000, 20, 1, "a", "same"), ("c", "message_1.db", "regular", 8, "0", 1700000000, 30, 9223372032559808513, "", "four"),
]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_types_and_content(spark):
    lit = F.lit
    r = one(
        spark, folded=scalars.norm_type(lit(9223372032559808513)), neg=scalars.norm_type(lit(-1)), label=scalars.type_label(lit(77)), group=scalars.split_prefix(lit("wxid_member:\n群聊中文正文"), lit(True)),
        alone=scalars.split_prefix(lit("wxid_member:\nx"), lit(False)), app=scalars.content_text(lit(49), lit("<appmsg><title><![CDATA[T]]></title><des>D</des><fileext>pdf</fileext><url>http://u</url><appname>A</appname></appmsg>")),
        bare=scalars.content_text(lit(49), lit("<appmsg></appmsg>")), image=scalars.content_text(lit(3), lit("<img/>")), card=scalars.content_text(lit(42), lit("<x><nickname>N</nickname></x>")),
        system=F.length(scalars.content_text(lit(10000), lit("<a>" + "字" * 400 + "</a>"))), odd=scalars.content_text(lit(77), lit("x")), attr=scalars.xml_attr(lit("<a md5 = 'X' >"), "md5"),
    )
    assert (r.folded, r.neg, r.label) == (1, 4294967295, "type_77")
    assert (r.group.sender_prefix, r.group.body, r.alone.body) == ("wxid_member", "群聊中文正文", "wxid_member:\nx")
    assert r.app == "T — D — [文件 .pdf] — http://u — (A)" and r.bare == "[链接/应用消息]" and r.image == "[图片]" and r.card == "[名片] N" and r.system == 300 and r.odd == "[type_77]" and r.attr == "X"


def test_text_helpers(spark):
    lit = F.lit
    r = one(
        spark, grams=scalars.ngrams(lit("季度计划 Plan_A 季度")), tokens=scalars.search_tokens(lit("汉字abcd")), urls=urls.extract_urls(lit("看 https://a.b/c?x=1。 http://a.b, HTTP://A.b:80"), lit("<u>https://a.b/c?x=1&amp;y=2</u>")), time=scalars.norm_time(lit("2024年1月2日 3：04")),
        raw=scalars.norm_time(lit("yesterday")), clean=scalars.clean_text(lit(" a&nbsp;b　 &lt;c&gt; ")), html=scalars.clean_text(scalars.strip_html(lit("<p>a<br>b</p><script>x()</script>c"))), stem=rules.duplicate_stem(lit("Report (3).PDF")),
        plain=rules.duplicate_stem(lit("a.txt")), safe=rules.safe_name(lit(' a<b>:"c" ')), none=rules.safe_name(lit("  ")), ts=scalars.archive_ts(lit(1720000000), "America/New_York"), title=rules.insight_title(lit("http://x.y 第一句。第二句")),
        signals=rules.signals(lit("学习 Python 和 哲学")), default=rules.signals(lit("zzz")), hashes=scalars.lookup_hashes(lit("a" * 32 + " " + "b" * 33)),
    )
    assert r.grams == ["季度", "度计", "计划", "季度计", "度计划", "plan_a"] and r.tokens == 3 and r.urls == ["https://a.b/c?x=1", "http://a.b/", "https://a.b/c?x=1&y=2"]
    assert (r.time, r.raw, r.clean, r.html) == ("2024-01-02 03:04:00", "yesterday", "a b <c>", "a b c")
    assert (r.stem.key, r.stem.serial, r.plain.serial) == ("report.pdf", 3, 0) and r.safe == "a_b___c_" and r.none == "unnamed"
    assert r.ts == "2024-07-03 05:46:40 -04:00" and r.title == "第一句" and r.signals == ["AI/技术", "哲理/方法"] and r.default == ["一般内容"] and r.hashes == ["a" * 32]


@pytest.mark.parametrize("url,ok", [("https://a.com/x", True), ("http://user@a.com", False), ("ftp://a.com", False), ("http://10.1.2.3", False), ("http://172.31.0.1/", False), ("http://172.32.0.1/", True), ("http://[::1]/", False), ("http://x.local", False), ("nonsense", False)])
def test_public_url(spark, url, ok):
    assert one(spark, v=scalars.is_public_url(F.lit(url))).v is ok


def test_canonical_order_and_duplicates_do_not_depend_on_partitions(spark):
    want = None
    for seed in range(3):
        rows = ROWS[:]
        random.Random(seed).shuffle(rows)
        df = canonical.with_canonical_seq(canonical.dedup_messages(spark.createDataFrame(rows, MSG).repartition(3)))
        got = [(r.text, r.source_db, r.canonical_seq) for r in df.orderBy("canonical_seq").collect()]
        want = want or got
        assert got == want
    assert [t for t, *_ in want] == ["one", "two", "same", "four"] and want[2][1] == "message_1.db"


def test_conflicting_copies_fail(spark):
    rows = [*ROWS, ("c", "message_2.db", "regular", 9, "1002", 1700000000, 50, 1, "a", "other")]
    with pytest.raises(canonical.ConflictError):
        canonical.dedup_messages(spark.createDataFrame(rows, MSG))


def test_private_chats_exclusions_and_no_conversation(spark):
    cols = "conv_id string, source_db string, local_id long, server_id string, occurred_at_epoch_s long, source_sort_seq long, source_adapter string, raw_type long, real_sender_id long, sender string, text string, is_own boolean, exclusion_reason string"
    row = lambda conv, n, own=None, why=None, sender=None: (conv, "message_0.db", n, str(n), 86_400 * n, n, "regular", 1, 9, sender, "x", own, why)
    raw = spark.createDataFrame([row("ann", 1, True), row("ann", 2, False), row("ann", 3), row("g@chatroom", 4, True, None, "bob"), row("g@chatroom", 5, True), row("ann", 6, True, "missing_columns"), *[row(None, n, False) for n in (7, 8, 9)], row("ann", 2, False)], cols)
    ids = spark.createDataFrame([("message_0.db", 1, "zoe")], "source_db string, rowid long, user_name string")
    out = canonical.build_canonical(raw, ids, "me")
    got = {(r.conv_id, r.local_id): (r.sender, r.sender_source, r.canonical_seq) for r in out["messages"].collect()}
    assert got == {
        ("ann", 1): ("me", "private_self", 0), ("ann", 2): ("ann", "private_peer", 1), ("ann", 3): (None, "unknown", 2), ("g@chatroom", 4): ("bob", "group_prefix", 0), ("g@chatroom", 5): (None, "unknown", 1),
        (None, 7): (None, "private_peer", 0), (None, 8): (None, "private_peer", 1), (None, 9): (None, "private_peer", 2),
    }
    assert [tuple(r) for r in out["inventory"].collect()] == [("message_0.db", 10, 8, 1, 1)]
    runs = timeline.timeline_items(out["messages"], "UTC").filter("conv_id IS NULL").orderBy("canonical_seq").collect()
    assert [r.run for r in runs] == [1, 2, 3]


def test_build_canonical_closes(spark):
    ids = spark.createDataFrame([("message_0.db", 1, "x"), ("message_1.db", 1, "y")], "source_db string, rowid long, user_name string")
    rows = spark.createDataFrame(ROWS, MSG).withColumns({"real_sender_id": F.lit(1).cast("long"), "conv_id": F.concat("conv_id", F.lit("@chatroom"))})
    out = canonical.build_canonical(rows, ids, "me")
    r = out["receipt"].first()
    assert (r.discovered, r.parsed, r.deduplicated, r.messages) == (5, 4, 1, 4)
    who = {m.text: (m.sender, m.sender_source) for m in out["messages"].collect()}
    assert who["one"] == ("x", "id_map") and who["two"] == ("b", "group_prefix") and who["four"] == ("y", "id_map")


def test_resolve_owner(spark):
    c = spark.createDataFrame([("alice",), ("alina",), ("alice@chatroom",)], "username string")
    assert views.resolve_owner(c, "alice") == "alice"
    for bad in ("ali", "bob"):
        with pytest.raises(ValueError):
            views.resolve_owner(c, bad)


def test_audits_find_one_fault_each(spark):
    m = canonical.with_canonical_seq(canonical.dedup_messages(spark.createDataFrame(ROWS, MSG))).withColumns({"type": scalars.norm_type(F.col("raw_type")), "message_uid": F.concat("source_db", F.col("local_id").cast("string")), "archive_day": scalars.archive_day(F.col("occurred_at_epoch_s"), "UTC")})
    codes = lambda df: [r.code for r in audit.audit_messages(df, "UTC").collect()]
    at = F.col("canonical_seq") == 1
    assert codes(m) == []
    assert codes(m.withColumn("text", F.when(at, "�").otherwise(F.col("text")))) == ["replacement-character"]
    assert codes(m.withColumn("type", F.when(at, 3).otherwise(F.col("type")))) == ["message-type-not-normalized"]
    assert codes(m.withColumn("archive_day", F.when(at, "x").otherwise(F.col("archive_day")))) == ["archive-day-mismatch"]
    assert codes(m.withColumn("source_sort_seq", F.when(at, 999).otherwise(F.col("source_sort_seq")))) == ["same-second-source-order-mismatch"]
    assert codes(m.withColumn("message_uid", F.lit("u"))) == ["duplicate-message-uid"]
    assert [r.detail for r in audit.audit_schema(m, ["text", "nope"]).collect()] == ["nope"]


def test_table_fingerprint_ignores_order(spark):
    a = spark.createDataFrame(ROWS, MSG)
    f = lambda d: canonical.table_fingerprint(d).first()[0]
    assert f(a) == f(a.repartition(4).orderBy(F.desc("text"))) != f(a.limit(4))


def test_snapshots(spark):
    k = [("o", s, t, str(i)) for s, t, ids in (("old", 1, range(5)), ("new", 2, range(9)), ("odd", 1, [1, 99])) for i in ids]
    got = canonical.select_snapshots(spark.createDataFrame(k, "owner string, snapshot string, updated_at long, key string")).collect()
    assert [tuple(r) for r in got] == [("o", "old", "new")]


def test_timeline(spark):
    m = spark.createDataFrame([("c", i, f"m{i}", 1000 + 100 * i + 500 * (i >= 5), "ab"[i // 3 % 2], "50%_x" if i == 4 else "t") for i in range(10)], "conv_id string, canonical_seq long, message_uid string, occurred_at_epoch_s long, sender string, text string")
    ids = lambda d: [r.canonical_seq for r in d.collect()]
    assert ids(timeline.timeline_page(m, "c", limit=3)) == [7, 8, 9] and ids(timeline.timeline_page(m, "c", before=5, limit=2)) == [3, 4] and ids(timeline.timeline_page(m, "c", after=5, limit=2)) == [6, 7]
    assert ids(timeline.timeline_around(m, "c", 4, 4)) == [3, 4, 5, 6] and ids(timeline.timeline_page(m, "c", q="%_")) == [4]
    assert sorted(ids(timeline.message_context(m, "m0", 2))) == [0, 1, 2]
    assert [r.breaks for r in timeline.timeline_items(m, "UTC").orderBy("canonical_seq").collect()] == [True, False, False, True, False, True, True, False, False, True]
    c = timeline.Cursor("r", 3, "u")
    assert timeline.Cursor.decode(c.encode(), "r") == c and timeline.Cursor.decode(c.encode(), "s") is None
    with pytest.raises(ValueError):
        timeline.Cursor.decode("!!", "r")
    with pytest.raises(ValueError):
        timeline.offset_page(m, ["canonical_seq"], 5, 99)


def test_search_ties_and_fusion(spark):
    chunks = spark.createDataFrame([(c, "k", 1, 1, ["s"], "季度_计划% alpha") for c in "zyxwa"], "chunk_id string, conv_id string, end_time long, last_sequence long, sender_ids array<string>, text string")
    p = search.build_index(chunks)
    assert [r.chunk_id for r in search.keyword_search(chunks, p, "alpha", 1).collect()] == ["a"]
    assert search.exact_search(chunks, "季度_计划%", 5).count() == 5 and search.exact_search(chunks, "季度x计划%", 5).count() == 0
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.8, 0.2, 0.0]), ("c", [-1.0, 0.0, 0.0])], "chunk_id string, vector array<float>")
    assert [r.chunk_id for r in search.vector_search(v, [1.0, 0.0, 0.0], 3).collect()] == ["a", "b", "c"]
    assert [r.problem for r in search.validate_vectors(v.union(spark.createDataFrame([("d", [0.0] * 3), ("e", [1.0]), ("f", [float("nan"), 1.0, 1.0])], v.schema)), 3).orderBy("chunk_id").collect()] == ["zero", "dimension", "not_finite"]
    ranked = lambda ids: spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids)], "chunk_id string, rank int")
    assert [r.chunk_id for r in search.rrf([ranked("zs"), ranked("as")], 9).collect()] == ["s", "a", "z"]
    hits = lambda **k: search.hybrid_search(chunks, p, "alpha", 2, **k)[1]
    assert hits() == "not_configured" and hits(vectors=v) == "vector_unavailable" and hits(vectors=v, query=[1.0], dims=3) == "embedding_mismatch" and hits(vectors=v, query=[1.0, 0.0, 0.0], dims=3) is None


@pytest.mark.parametrize("parts,batch", [(1, 10000), (7, 3)])
def test_chunks_do_not_depend_on_batches(spark, parts, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        m = spark.createDataFrame([(c, i, f"{c}{i}", "汉" * 100) for c in "pq" for i in range(14)], "conv_id string, canonical_seq long, message_uid string, text string").repartition(parts)
        got = search.chunk_messages(m, 800, 100).filter("conv_id = 'p'").orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [(r.first_uid, r.last_uid, r.token_count) for r in got] == [("p0", "p7", 800), ("p7", "p13", 700)]
    assert all(r.token_count <= 800 for r in got)


def test_long_message_is_split(spark):
    m = spark.createDataFrame([("c", 0, "u", "汉" * 900 + "😀")], "conv_id string, canonical_seq long, message_uid string, text string")
    got = search.chunk_messages(m).collect()
    assert len(got) == 2 and {r.first_uid for r in got} == {"u"} and all(r.token_count <= 800 for r in got)


def test_resource_alignment_and_files(spark):
    f = ("message_uid", "chat_table", "local_id", "server_id")
    m = spark.createDataFrame([("u1", "t", 1, "9"), ("u2", "t", 2, "9"), ("u3", "t", 3, "0")], "message_uid string, chat_table string, local_id long, server_id string")
    p = spark.createDataFrame([("exact", "u1", "t", 1, "9"), ("partial", None, "t", 3, None), ("missing", None, "t", 8, "0"), ("conflict", None, "t", None, "9"), ("differs", "u3", "t", 2, None)], "resource_id string, message_uid string, chat_table string, local_id long, server_id string")
    got = {r.resource_id: r.verdict for r in assets.align_resources(p, m, f).collect()}
    assert got == {"exact": "conflict", "partial": "partial", "missing": "missing", "conflict": "conflict", "differs": "conflict"}
    files = spark.createDataFrame([("/a/x.pdf", "x.pdf", 5), ("/b/X.pdf", "X.pdf", 6), ("/c/" + "a" * 32 + ".dat", "a" * 32 + ".dat", 7), ("/d/y.txt", "y.txt", 1)], "path string, name string, size long")
    r = spark.createDataFrame([("sized", "x.pdf", 5, []), ("either", "x.pdf", None, []), ("wrong", "y.txt", 9, []), ("hash", "q", 7, ["a" * 32]), ("gone", "z", 1, [])], "resource_id string, name string, size long, hashes array<string>")
    assert {x.resource_id: x.status for x in assets.match_files(r, files).collect()} == {"sized": "filename_only", "either": "ambiguous", "wrong": "size_mismatch", "hash": "exact", "gone": "missing"}


def test_packed_strings(spark):
    good = bytes([0x0A, 32]) + b"0123456789abcdef" * 2 + bytes([0x12, 5]) + b"a.pdf" + bytes([0x18, 1])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"\x0a\xff")), (3, None)], "resource_id int, packed binary")
    got = {r.resource_id: (r.valid, r.hashes, r.names) for r in assets.packed_strings(df, 4).collect()}
    assert got == {1: (True, ["0123456789abcdef" * 2], ["a.pdf"]), 2: (False, [], []), 3: (False, [], [])}


def test_packed_strings_of_any_depth_and_length(spark):
    def field(n, part):
        size, out = len(part), b""
        while size > 127:
            size, out = size >> 7, out + bytes([size & 127 | 128])
        return bytes([n << 3 | 2]) + out + bytes([size]) + part

    h, rows, want = "0123456789abcdef" * 2, [], {}
    for depth in (0, 4, 5, 6, 7, 60, 2000, 20_000):
        b = field(1, h.encode()) + field(2, f"depth{depth}.pdf".encode())
        for _ in range(depth):
            b = field(3, b)
        rows += [(depth, b + b"\x18\x01"), (-1 - depth, b + b"\x0a\xff")]
        want |= {depth: (True, [h], [f"depth{depth}.pdf"]), -1 - depth: (False, [h], [f"depth{depth}.pdf"])}
    called = ["n" * k + ".pdf" for k in (200, 201, 255, 100_000)] + ["site.photoslibrary", "注" * 300 + ".docx"]
    rows += [(10**6, b"".join(field(1, x.encode()) for x in [*called, "a/b.pdf", "no name", "x" * 300]))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "resource_id int, packed binary")
    got = {r.resource_id: (r.valid, r.hashes, r.names) for r in assets.packed_strings(df).collect()}
    assert got == want | {10**6: (True, [], sorted(called))}


def test_insight_refresh_checks_its_growth(spark):
    m = spark.createDataFrame([("c", i, f"u{i}", "s", "please review the plan number %d" % i) for i in range(10)], "conv_id string, canonical_seq long, message_uid string, sender string, text string")
    conv = spark.createDataFrame([("c", 10)], "conv_id string, text_count long")
    state = lambda n, uid: spark.createDataFrame([("c", n, uid)], "conv_id string, analyzed_text_count long, analyzed_last_message_uid string")
    n, after = insights.refresh_insights(m, conv, state(2, "u1"), 8)
    assert n.count() == 5 and after.first().analyzed_last_message_uid == "u9"
    with pytest.raises(ValueError):
        insights.refresh_insights(m, conv, state(2, "u5"), 8)
    assert insights.refresh_insights(m, conv, state(5, "u4"), 8)[0].count() == 0


def test_archive_plan_cases(spark):
    c = spark.createDataFrame([(1, "/s/a", "h1", "/A/n.txt"), (2, "/s/b", "h2", "/A/n.txt"), (3, "/s/c", "h1", "/A/m.txt"), (4, "/s/d", "h4", "/A/k.txt"), (5, "/s/e", "h5", "/A/old.txt")], "file_id long, path string, sha256 string, target string")
    prev = spark.createDataFrame([("h4", "/A/before.txt")], "sha256 string, archive_path string")
    have = spark.createDataFrame([("/A/old.txt", "zz")], "archive_path string, sha256 string")
    got = {r.file_id: (r.action, r.archive_path) for r in library.plan_archive(prev, c, have).collect()}
    assert got == {1: ("copy", "/A/n.txt"), 2: ("copy", "/A/n-h2.txt"), 3: ("reuse", "/A/n.txt"), 4: ("reuse", "/A/before.txt"), 5: ("copy", "/A/old-h5.txt")}


def test_export_readers(spark, tmp_path):
    j = spark.createDataFrame([("a", '{"x": [{"from": "p", "time": "1", "content": "hello"}, {"deep": {"sender": "q", "msg": "there"}}]}'), ("b", "{broken")], "path string, text string")
    assert [(r.sender, r.content) for r in views.read_json_exports(j).orderBy("n").collect()] == [("p", "hello"), ("q", "there")]
    c = spark.createDataFrame([("c.csv", "Nickname,Date,Message\nann,2024/1/2 3:04,hi there, more\n\nbob,,[图片]\nAuthor,,zzz\n,,zzz\nbob"), ("d.csv", "时间\t发言人\t正文\r\nx\tann:\t a&lt;b \r\n"), ("e.csv", "a,b\n1,2"), ("f.csv", "")], "path string, text string")
    assert [tuple(r) for r in views.read_csv_exports(c).orderBy("path", "n").collect()] == [("c.csv", 0, "ann", "2024-01-02 03:04:00", "hi there", False), ("d.csv", 0, "ann", "x", "a<b", False)]
    h = spark.createDataFrame([("a.html", "<p>2024-01-02 03:04 ann: hi <b>there</b></p>\n<p>more</p>"), ("b.txt", "2024-01-02 03:04 bob: <p>")], "path string, text string")
    assert [(r.path, r.sender, r.content) for r in views.read_text_exports(views.export_lines(h)).orderBy("path").collect()] == [("a.html", "ann", "hi there more"), ("b.txt", "bob", "<p>")]
    (tmp_path / "c.csv").write_text("x")
    inv = views.file_inventory(spark, str(tmp_path)).first()
    assert (inv.name, inv.ext) == ("c.csv", ".csv")
    m = sinks.bundle_files(spark, str(tmp_path))
    changed = m.withColumn("sha256", F.lit("x"))
    assert sinks.verify_bundle(m, m).count() == 0 and sinks.verify_bundle(m, changed).first().problem == "digest" and sinks.bundle_manifest(m).first().bundle_digest


def test_shards_are_read_with_missing_columns(spark, tmp_path):
    base = spark.createDataFrame([(1, "5", 1, 1, 1, 1, "x")], "local_id long, server_id string, local_type long, sort_seq long, real_sender_id long, create_time long, message_content string")
    base.write.parquet(str(tmp_path / "message_0.db.parquet"))
    base.withColumn("compress_content", F.lit(b"z")).write.parquet(str(tmp_path / "biz_message_1.db.parquet"))
    got = views.read_shards(spark, [str(tmp_path / "message_0.db.parquet"), str(tmp_path / "biz_message_1.db.parquet")]).orderBy("source_db").collect()
    assert [(r.source_db, r.source_domain, r.compress_content) for r in got] == [("biz_message_1.db", "biz", bytearray(b"z")), ("message_0.db", "regular", None)]


def test_document_text_is_strict(spark):
    d = spark.createDataFrame([("a.txt", bytearray("héllo".encode())), ("b.txt", bytearray(b"\xff\xfe")), ("c.html", bytearray(b"<p>x</p>"))], "path string, content binary")
    assert {r.path: (r.text, r.truncated) for r in views.document_text(d, 3).collect()} == {"a.txt": ("hél", True), "b.txt": (None, False), "c.html": ("x", False)}


def test_budget(spark):
    d = spark.createDataFrame([(5,), (7,)], "n long")
    assert views.check_budget(d, "n", 2, 7, 12).count() == 2
    for bad in ((1, 7, 12), (2, 6, 12), (2, 7, 11)):
        with pytest.raises(ValueError):
            views.check_budget(d, "n", *bad)


def test_asset_scope_fails_closed(spark):
    inv = spark.createDataFrame([("d", "regular", 5)], "source_db string, domain string, parsed long")
    m = lambda *r: spark.createDataFrame(list(r), "owner string, username string, conv_id string, source_db string")
    assert reports.asset_scope(m(("o", "u", "c", "d")), inv).count() == 1
    for bad in ((("o", "u", "c", "d"), ("p", "v", "e", "d")), (("o", "u", "c", "d"), ("o", "u", "e", "d")), (("o", "u", "c", "lost"),)):
        with pytest.raises(ValueError):
            reports.asset_scope(m(*bad), inv)


def test_visible_text_reads_both_encodings(spark):
    """Han and Latin runs in UTF-8 and UTF-16LE, between bytes that are no text; noise and short runs stay out."""
    import re

    from threadloom.operators import library

    han, latin = "项目会议的消息正文在这里写得很清楚", "meeting notes of the project, été"
    rows = [
        ("a", b"\xff\x00" + han.encode() + b"\x00\xfe" + latin.encode() + b"\x01"), ("b", (han + "\n" + latin).encode("utf-16-le")),
        ("c", b"0123456789abcdef0123\x00short\x00" + b"z" * 40), ("d", b""), ("e", None),
    ]
    got = library.visible_text(spark.createDataFrame(rows, "path string, content binary")).collect()
    utf8 = {(r.path, r.run) for r in got if r.encoding == "utf8"}
    assert {("a", han), ("a", latin)} <= utf8 and not any(p in "cde" for p, _ in utf8)
    assert {("b", han), ("b", latin)} <= {(r.path, r.run) for r in got if r.encoding == "utf16le"}
    assert all(len(r.run) >= 12 and not re.search(r"[\n\x00]", r.run) for r in got)


def test_search_in_scope(spark):
    """Ids of first and last messages are found; scope holds for keywords, vectors and messages; ties go by conversation and from the last message back."""
    from threadloom.operators import search

    cols = "chunk_id string, conv_id string, first_uid string, last_uid string, sender_ids array<string>, start_time long, end_time long, last_sequence long, text string"
    chunks = spark.createDataFrame([
        ("z", "c1", "u1", "u4", ["a"], 0, 10, 4, "plan for spring"), ("y", "c1", "u4", "u9", ["b"], 10, 20, 9, "plan for autumn"),
        ("x", "c2", "v1", "v2", ["a", "b"], 5, 15, 2, "nothing of it")], cols)
    found = lambda q, **s: [r.chunk_id for r in search.exact_search(chunks, q, 5, **s).collect()]
    assert found("u4") == ["y", "z"] and found("v2") == ["x"] and found("plan") == ["y", "z"] and found("plan", sender="a") == ["z"]
    assert found("plan", after=15) == ["y"] and found("plan", before=5) == ["z"] and found("plan", conv="c2") == []
    p = search.build_index(chunks)
    words = lambda **s: [r.chunk_id for r in search.keyword_search(chunks, p, "plan nothing", 5, **s).orderBy("rank").collect()]
    assert words() == ["x", "y", "z"] and words(sender="b") == ["x", "y"] and words(conv="c1", before=5) == ["z"]
    v = spark.createDataFrame([("z", [1.0, 0.0]), ("y", [0.8, 0.2]), ("x", [0.0, 1.0])], "chunk_id string, vector array<double>")
    got, why = search.hybrid_search(chunks, p, "plan", 5, v, [1.0, 0.0], 2, conv="c1")
    assert why is None and [r.chunk_id for r in got.collect()] == ["y", "z"]
    assert search.hybrid_search(chunks, p, "plan", 5, v, [1.0], 2)[1] == "embedding_mismatch"
    ranked = lambda ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "chunk_id string, rank int")
    assert [r.chunk_id for r in search.rrf([ranked("zx"), ranked("yx")], 5, chunks=chunks).collect()] == ["x", "y", "z"]
    m = spark.createDataFrame([("c1", 1, "a", 5, "plan"), ("c1", 2, "b", 6, "plan"), ("c2", 1, "a", 9, "plan")], "conv_id string, canonical_seq long, sender string, occurred_at_epoch_s long, text string")
    live = lambda **s: [(r.conv_id, r.canonical_seq) for r in search.live_search(m, "PLAN", 5, **s).collect()]
    assert live() == [("c2", 1), ("c1", 2), ("c1", 1)] and live(sender="a", before=5) == [("c1", 1)] and live(conv="c1", after=6) == [("c1", 2)]


def test_text_exports_drop_what_is_no_message(spark):
    rows = ["2024-01-02 03:04 Ann: hi there", "more", "2024-01-02 03:05 Author: git", "2024/1/2 03:06 Bob: [图片]", "2024-01-03", "Cy 2024年1月4日 05:06： yes", "", "too"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(rows)], "path string, line_no int, line string")
    got = sorted((r.seq, r.time, r.sender, r.content) for r in views.read_text_exports(lines).collect())
    assert got == [(1, "2024-01-02 03:04:00", "Ann", "hi there more"), (2, "2024-01-04 05:06:00", "Cy", "yes too")]


def test_synthesis_has_six_sections(spark):
    rows = [
        ("聊天导出", "/a", "学业", 40, "high", ["长期目标"]), ("聊天导出", "/b", "none", 5, "low", ["hello"]),
        ("log", "/nt_msg/x", "技术", 30, "medium", ["API"]), ("log", "/c", "学业", 30, "medium", ["x"]), ("log", "/d", "none", 1, "low", ["x"]),
    ]
    g = spark.createDataFrame([(*r, len(r[5])) for r in rows], "source_type string, path string, signals string, score int, band string, texts array<string>, excerpts int")
    g = g.withColumn("verdict", library.clue_verdict(F.col("source_type"), F.col("path"), F.col("signals")))
    got = {}
    for r in library.clue_synthesis(g).orderBy("section", "rank").collect():
        got.setdefault(r.section, []).append(r.path)
    assert got == {
        "confirmed-conversations": ["/a", "/b"], "technical-value": ["/nt_msg/x"], "academic-material": ["/a", "/c"],
        "philosophy-method": ["/a"], "source-boundaries": ["/nt_msg/x"], "high-value-review": ["/a"],
    }


def test_app_folders_keep_whole_pictures_only(spark):
    at = "\\xwechat\\radium\\users\\u\\applet\\local\\k\\temp\\"
    rows = [(at + "abc.png", 5), (at + "zed.png", 5), (at + "zed.png", 1 << 20), (at + "a@2x.png", 1 << 20), (at + "zed.pdf", 5), ("\\xwechat\\radium\\users\\u\\abc.pdf", 5), ("C:\\cache\\abc.pdf", 5)]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, size long")
    assert sorted(r.i for r in reports.eligible_files(f).collect()) == [0, 2, 4]


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_text("hello")
    got = views.file_inventory(spark, str(tmp_path)).collect()
    assert [(r.root, r.relative, r.name, r.ext, r.size) for r in got] == [(str(tmp_path), "d/a.TXT", "a.TXT", ".txt", 5)]
