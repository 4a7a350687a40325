"""Queries on messages: scans, senders, order, duplicates, rollups, timelines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import audit, canonical, digests, sinks, timeline
from threadloom.plans.registry import CO, EV, FI, IM, MS, SH, TU, query
from threadloom.sources import views

ZONE = "Asia/Shanghai"


def messages(spark, sf):
    return canonical.with_canonical_seq(views.events(spark, sf)).withColumn("type", scalars.norm_type(F.col("raw_type")))


@query("r2_1_1_shard_scan", f"WITH {SH} SELECT source_db, local_id, server_id, sort_seq AS source_sort_seq FROM sh")
def shard_scan(spark, sf):
    return views.shards(spark, sf).select("source_db", "local_id", "server_id", "source_sort_seq")


@query("r2_1_2_source_domain", f"WITH {SH} SELECT source_db, CASE WHEN source_db LIKE 'biz%' THEN 'biz' ELSE 'regular' END AS domain, count(*) AS row_count FROM sh GROUP BY ALL")
def source_domain(spark, sf):
    return views.shards(spark, sf).groupBy("source_db", views.source_domain(F.col("source_db")).alias("domain")).agg(F.count("*").alias("row_count"))


@query("r2_1_4_deferred_inventory", f"WITH {SH} SELECT source_db, count(*) AS discovered, 'deferred_domain' AS reason FROM sh WHERE source_db LIKE 'biz%' GROUP BY source_db")
def deferred(spark, sf):
    return views.deferred_inventory(views.shards(spark, sf), ("regular",))


@query("r2_1_5_contacts", f"WITH {CO}, r AS (SELECT 'Customer#' || s_suppkey || '@chatroom' AS username FROM supplier) SELECT username, coalesce(nullif(trim(remark), ''), nullif(trim(nick), ''), nullif(trim(alias), ''), username) AS display, FALSE AS is_group FROM co UNION ALL SELECT username, username, TRUE FROM r")
def contacts(spark, sf):
    rooms = views.table(spark, sf, "supplier").select(F.concat(F.lit("Customer#"), F.col("s_suppkey").cast("string"), F.lit("@chatroom")).alias("username"))
    return views.read_contacts(views.contacts(spark, sf), rooms)


@query("r2_1_6_sessions", f"WITH {EV} SELECT conv_id AS username, max(t) AS last_time FROM ev GROUP BY conv_id")
def sessions(spark, sf):
    e = views.events(spark, sf).select(F.col("conv_id").alias("username"), F.col("occurred_at_epoch_s").alias("last_time"), F.col("text").alias("summary"))
    return views.read_sessions(e).drop("summary")


@query("r2_1_7_resolve_owner", "SELECT c_name AS owner FROM customer WHERE c_custkey = 7")
def owner(spark, sf):
    c = views.table(spark, sf, "customer")
    name = c.filter("c_custkey = 7").first()["c_name"]
    return spark.createDataFrame([(views.resolve_owner(views.contacts(spark, sf), name),)], "owner string")


@query("r2_1_12_adapt_legacy", f"WITH {TU} SELECT conv_id, seq AS canonical_seq, 'legacy:' || seq || ':' || sha256(conv_id || chr(0) || '0' || chr(0) || sender || chr(0) || text) AS message_uid FROM tu")
def legacy(spark, sf):
    t = views.turns(spark, sf).withColumnRenamed("canonical_seq", "rowid").withColumn("occurred_at_epoch_s", F.lit(0).cast("long"))
    return views.adapt_legacy(t).select("conv_id", "canonical_seq", "message_uid")


@query("r2_1_13_resources", "SELECT o_orderkey AS message_id, o_orderstatus AS status, l_linenumber AS resource_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def resources(spark, sf):
    info = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderstatus").alias("status"))
    detail = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("resource_id"))
    return views.read_resources(info, detail)


@query("r2_3_1_types", f"WITH {EV} SELECT raw_type, raw_type % 4294967296 AS type, CASE raw_type % 4294967296 WHEN 1 THEN 'text' ELSE 'type' END AS label, count(*) AS row_count FROM ev GROUP BY ALL")
def types(spark, sf):
    k = scalars.norm_type(F.col("raw_type"))
    return views.events(spark, sf).groupBy("raw_type", k.alias("type"), scalars.type_label(k).alias("label")).agg(F.count("*").alias("row_count"))


@query("r2_3_3_group_prefix", f"WITH {TU} SELECT conv_id, seq, CASE WHEN seq % 2 = 0 THEN sender ELSE '' END AS sender_prefix, md5(CASE WHEN seq % 2 = 0 THEN text ELSE sender || ':' || chr(10) || text END) AS body FROM tu")
def prefix(spark, sf):
    t = views.turns(spark, sf)
    p = scalars.split_prefix(F.concat("sender", F.lit(":\n"), "text"), F.col("canonical_seq") % 2 == 0)
    return t.select("conv_id", F.col("canonical_seq").alias("seq"), p.alias("p")).select("conv_id", "seq", "p.sender_prefix", F.md5("p.body").alias("body"))


@query("r2_3_4_xml_tag", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ' || chr(10) || chr(9)) AS title, trim(regexp_extract(html, '(?is)\slang\s*=\s*(["''])(.*?)(["''])', 2)) AS lang FROM pages""")
def xml(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", scalars.xml_tag(F.col("html"), "title").alias("title"), scalars.xml_attr(F.col("html"), "lang").alias("lang"))


@query("r2_3_7_app_text", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1).trim() || ' — [文件 .html]' AS app_text FROM pages WHERE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1).trim() <> ''")
def app_text(spark, sf):
    p = views.table(spark, sf, "pages").filter(scalars.xml_tag(F.col("html"), "title") != "")
    body = F.concat(F.lit("<appmsg><title>"), scalars.xml_tag(F.col("html"), "title"), F.lit("</title><fileext>html</fileext></appmsg>"))
    return p.select("page_id", scalars.app_text(body).alias("app_text"))


@query("r2_3_8_system_text", r"SELECT page_id, left('[系统] ' || regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), 300) AS text FROM pages")
def system_text(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", scalars.system_text(F.col("html")).alias("text"))


@query("r2_3_9_pick_payload", f"WITH {EV} SELECT message_uid, coalesce(nullif(CASE WHEN sort_seq % 3 = 0 THEN '' ELSE text END, ''), sender) AS payload FROM ev")
def payload(spark, sf):
    return views.events(spark, sf).select("message_uid", scalars.pick_payload(F.when(F.col("source_sort_seq") % 3 == 0, "").otherwise(F.col("text")), F.col("sender")).alias("payload"))


@query("r2_3_10_archive_time", f"WITH {MS} SELECT message_uid, day, strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' +08:00' AS stamp FROM ms")
def archive_time(spark, sf):
    t = F.col("occurred_at_epoch_s")
    return views.events(spark, sf).select("message_uid", scalars.archive_day(t, ZONE).alias("day"), scalars.archive_ts(t, ZONE).alias("stamp"))


@query("r2_3_11_person_id", "SELECT c_name AS username, 'wxp:' || sha256('me' || chr(0) || trim(c_name)) AS person_id, 'Msg_' || md5(c_name) AS source_table, 'wx:me:' || c_name AS conv_id FROM customer")
def person(spark, sf):
    n = F.col("c_name")
    return views.table(spark, sf, "customer").select(n.alias("username"), scalars.person_id(F.lit("me"), n).alias("person_id"), scalars.msg_table(n).alias("source_table"), scalars.conv_id(F.lit("me"), n).alias("conv_id"))


@query("r2_3_12_message_uid", f"WITH {SH} SELECT source_db, local_id, sha256(conv_id || chr(10) || CASE WHEN server_id <> '0' THEN 's:' || server_id ELSE 'l:' || source_db || ':t:' || local_id END) AS uid FROM sh")
def uid(spark, sf):
    return views.shards(spark, sf).select("source_db", "local_id", scalars.message_uid(F.col("conv_id"), F.col("server_id"), F.col("source_db"), F.lit("t"), F.col("local_id")).alias("uid"))


@query("r2_3_14_resolve_sender", f"WITH {EV}, {IM} SELECT message_uid, coalesce(user_name, CASE WHEN sort_seq % 2 = 0 THEN sender END) AS sender, CASE WHEN user_name IS NOT NULL THEN 'id_map' WHEN sort_seq % 2 = 0 THEN 'group_prefix' ELSE 'unknown' END AS sender_source, CASE WHEN user_name IS NOT NULL AND sort_seq % 2 = 0 THEN 'prefix_mismatch' WHEN user_name IS NULL AND sort_seq % 2 = 1 THEN 'sender_unresolved' END AS sender_audit FROM ev LEFT JOIN im ON ev.source_db = im.source_db AND real_sender_id = rowid")
def resolve(spark, sf):
    j = canonical.join_senders(views.events(spark, sf), views.id_map(spark, sf))
    s = scalars.resolve_sender(F.lit(True), F.col("mapped_sender"), F.when(F.col("local_id") % 2 == 0, F.col("sender")), F.lit("me"), F.col("conv_id"), F.lit(None).cast("boolean"))
    return j.select("message_uid", s.alias("s")).select("message_uid", "s.*")


@query("r2_3_18_ngrams", f"WITH {TU} SELECT conv_id, seq, array_to_string(list_transform(w, lambda x: x[2]), ' ') AS ngrams FROM (SELECT conv_id, seq, list_sort(list_transform(list_distinct(g), lambda x: [lpad(CAST(list_position(g, x) AS VARCHAR), 9, '0'), x])) AS w FROM (SELECT conv_id, seq, list_transform(regexp_extract_all(text, '(?i)[a-z0-9_:@.-]+'), lambda x: lower(x)) AS g FROM tu))")
def ngrams(spark, sf):
    return views.turns(spark, sf).select("conv_id", F.col("canonical_seq").alias("seq"), F.array_join(scalars.ngrams(F.col("text")), " ").alias("ngrams"))


@query("r2_3_19_tokens", f"WITH {TU} SELECT conv_id, seq, CAST(ceil(length(text) / 4.0) AS BIGINT) AS search_tokens, CAST(ceil(length(text) / 3.5) AS BIGINT) AS prompt_tokens FROM tu")
def tokens(spark, sf):
    return views.turns(spark, sf).select("conv_id", F.col("canonical_seq").alias("seq"), scalars.search_tokens(F.col("text")).alias("search_tokens"), scalars.prompt_tokens(F.col("text")).alias("prompt_tokens"))


@query("r2_4_1_timeline_scope", f"WITH {MS} SELECT conv_id, seq, message_uid FROM ms WHERE coalesce(nullif(sender, ''), '?') = 'click' AND contains(lower(text), '1')")
def scope(spark, sf):
    return timeline.timeline_scope(messages(spark, sf), None, "click", "1").select("conv_id", F.col("canonical_seq").alias("seq"), "message_uid")


@query("r2_4_4_text_rows", f"WITH {MS} SELECT conv_id, count(*) AS texts FROM ms WHERE raw_type % 4294967296 = 1 AND length(text) > 0 GROUP BY conv_id HAVING count(*) >= 20")
def text_rows(spark, sf):
    return canonical.min_text(messages(spark, sf), 20)


@query("r2_5_1_join_senders", f"WITH {EV}, {IM} SELECT message_uid, user_name AS mapped_sender FROM ev LEFT JOIN im ON ev.source_db = im.source_db AND real_sender_id = rowid")
def join_senders(spark, sf):
    return canonical.join_senders(views.events(spark, sf), views.id_map(spark, sf)).select("message_uid", "mapped_sender")


@query("r2_5_2_join_contacts", f"WITH {CO} SELECT c_name AS username, coalesce(nullif(trim(remark), ''), nullif(trim(nick), ''), nullif(trim(alias), ''), username) AS display, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS last_time FROM customer JOIN co ON c_name = username")
def join_contacts(spark, sf):
    c = views.table(spark, sf, "customer")
    shown = views.read_contacts(views.contacts(spark, sf), c.select(F.col("c_name").alias("username")).limit(0))
    s = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("username"), F.lit("").alias("summary"), F.col("c_custkey").alias("last_time"))
    return canonical.join_contacts(c.select(F.col("c_name").alias("username")), shown, s).select("username", "display", "last_time")


@query("r2_5_3_join_tables", "SELECT 'Msg_' || md5(c_name) AS source_table, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS username FROM customer")
def join_tables(spark, sf):
    c = views.table(spark, sf, "customer")
    raw = c.select(scalars.msg_table(F.col("c_name")).alias("source_table"))
    return canonical.join_tables(raw, c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("username"))).select("source_table", "username")


@query("r2_5_12_reconcile_source", f"WITH {EV} SELECT 'source-text-mismatch' AS code, count(*) AS n FROM ev WHERE local_id % 13 = 0 AND local_id % 17 <> 0 AND local_id % 19 <> 0 UNION ALL SELECT 'source-row-missing', count(*) FROM ev WHERE local_id % 17 = 0 AND local_id % 19 <> 0 UNION ALL SELECT 'output-row-missing', count(*) FROM ev WHERE local_id % 19 = 0 AND local_id % 17 <> 0")
def reconcile(spark, sf):
    e = views.events(spark, sf)
    out = e.filter("local_id % 19 <> 0").withColumn("text", F.when(F.col("local_id") % 13 == 0, "changed").otherwise(F.col("text")))
    return canonical.reconcile_source(out, e.filter("local_id % 17 <> 0"), ("text", "sender", "server_id")).groupBy("code").agg(F.count("*").alias("n"))


@query("r2_5_13_select_snapshots", "SELECT 'me' AS owner, 'old' AS snapshot, 'mid' AS covered_by")
def snapshots(spark, sf):
    k = views.table(spark, sf, "events").select(F.lit("me").alias("owner"), "event_id")
    snap = lambda name, at, cond: k.filter(cond).select("owner", F.lit(name).alias("snapshot"), F.lit(at).alias("updated_at"), F.col("event_id").cast("string").alias("key"))
    return canonical.select_snapshots(snap("old", 1, "event_id % 4 = 0").union(snap("mid", 2, "event_id % 2 = 0")).union(snap("new", 3, "event_id % 3 = 0")))


@query("r2_5_15_orphans", f"WITH {EV} SELECT message_uid FROM ev WHERE CAST(conv_id AS BIGINT) % 5 = 0")
def orphan(spark, sf):
    e = views.events(spark, sf)
    return canonical.orphans(e, e.select("conv_id").distinct().filter("cast(conv_id as bigint) % 5 <> 0")).select("message_uid")


@query("r2_6_1_conversation_rollup", f"WITH {MS} SELECT conv_id, count(*) AS msg_count, count(*) FILTER (raw_type % 4294967296 = 1 AND length(text) > 0) AS text_count, min(t) AS first_time, max(t) AS last_time FROM ms GROUP BY conv_id")
def rollup(spark, sf):
    return canonical.conversation_rollup(views.events(spark, sf).withColumn("type", scalars.norm_type(F.col("raw_type"))))


WHO = """who AS (SELECT conv_id, t, CASE WHEN local_id % 13 = 0 THEN '' ELSE sender END AS s, CASE WHEN local_id % 2 = 0 THEN 'name of ' || sender ELSE '' END AS n,
  CASE WHEN local_id % 13 = 0 THEN NULL WHEN local_id % 170 = 1 THEN 'q' ELSE 'p' || sender END AS p FROM ev)"""


@query("r2_6_2_participants", f"""WITH {EV}, {WHO}, g AS (SELECT conv_id, coalesce(nullif(s, ''), nullif(n, ''), '?') AS sender_key, count(DISTINCT p) AS ps, max(p) AS p,
  nullif(max(n), '') AS n, nullif(max(s), '') AS s, count(*) AS messages, max(t) AS last_time FROM who GROUP BY ALL)
SELECT conv_id, sender_key, CASE WHEN ps = 1 THEN p END AS person_id, coalesce(n, s, '未知人物') AS name,
  CASE WHEN ps = 1 THEN 'person_id' WHEN s IS NOT NULL THEN 'sender' WHEN n IS NOT NULL THEN 'name_snapshot' ELSE 'unknown' END AS identity_source, messages, last_time FROM g""")
def participants(spark, sf):
    i, s = F.col("local_id"), F.col("sender")
    named = {
        "sender": F.when(i % 13 == 0, "").otherwise(s), "sender_name": F.when(i % 2 == 0, F.concat(F.lit("name of "), s)).otherwise(""),
        "person_id": F.when(i % 13 != 0, F.when(i % 170 == 1, "q").otherwise(F.concat(F.lit("p"), s))),
    }
    return timeline.participants(views.events(spark, sf).withColumns(named))


@query("r2_6_3_chat_totals", f"WITH {EV} SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, count(*) FILTER (length(text) > 0) AS texts FROM ev")
def totals(spark, sf):
    return timeline.chat_totals(rollup(spark, sf))


@query("r2_6_6_close_inventory", f"WITH {SH} SELECT source_db, count(*) AS discovered, count(*) FILTER (n = 1 AND local_id % 23 <> 0) AS parsed, count(*) FILTER (n > 1) AS deduplicated, count(*) FILTER (n = 1 AND local_id % 23 = 0) AS excluded, CASE WHEN count(*) FILTER (n = 1 AND local_id % 23 = 0) > 0 THEN 'not_parsed' ELSE '' END AS exclusion_reason FROM dd GROUP BY source_db")
def inventory(spark, sf):
    s = views.shards(spark, sf)
    kept = canonical.dedup_messages(s).select("source_db", "local_id", F.when(F.col("local_id") % 23 != 0, "parsed").otherwise("skipped").alias("outcome"))
    lost = s.join(kept.select("source_db", "local_id"), ["source_db", "local_id"], "left_anti").select("source_db", "local_id", F.lit("deduplicated").alias("outcome"))
    return canonical.close_inventory(s.groupBy("source_db").agg(F.count("*").alias("discovered")), kept.union(lost))


@query("r2_6_7_run_receipt", f"WITH {SH} SELECT count(*) AS discovered, count(*) FILTER (n = 1) AS parsed, count(*) FILTER (n > 1) AS deduplicated, 0::BIGINT AS excluded, count(*) FILTER (n = 1) AS messages, count(DISTINCT conv_id) AS conversations FROM dd")
def receipt(spark, sf):
    return canonical.build_canonical(views.shards(spark, sf), views.id_map(spark, sf), "me")["receipt"]


@query("r2_6_19_duplicates", f"WITH {SH} SELECT server_id, count(*) AS copies FROM sh WHERE server_id <> '0' GROUP BY server_id HAVING count(*) > 1")
def dups(spark, sf):
    return canonical.duplicates(views.shards(spark, sf).filter(scalars.clean_server_id(F.col("server_id")).isNotNull()), ["server_id"])


PARTS = ", ".join(f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT))::HUGEINT::VARCHAR AS s{i}" for i in range(4))


@query("r2_6_20_table_fingerprint", f"""WITH h AS (SELECT sha256('["=' || o_orderkey || '","=' || o_orderstatus || '","=' || o_custkey || '"]') AS h FROM orders), s AS (SELECT count(*) AS n, {PARTS} FROM h) SELECT sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS fingerprint FROM s""")
def fp(spark, sf):
    return canonical.table_fingerprint(views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))


@query("r2_7_1_canonical_seq", f"WITH {MS} SELECT conv_id, message_uid, seq AS canonical_seq FROM ms")
def seq(spark, sf):
    return canonical.with_canonical_seq(views.events(spark, sf)).select("conv_id", "message_uid", "canonical_seq")


@query("r2_7_2_dedup_messages", f"WITH {SH} SELECT conv_id, source_db, local_id FROM dd WHERE n = 1")
def dedup(spark, sf):
    return canonical.dedup_messages(views.shards(spark, sf)).select("conv_id", "source_db", "local_id")


@query("r2_7_3_day_facet", f"WITH {MS} SELECT conv_id, day, arg_min(message_uid, seq) AS first_uid, min(seq) AS first_seq, count(*) AS messages FROM ms GROUP BY ALL")
def days(spark, sf):
    return timeline.day_facet(messages(spark, sf), ZONE)


@query("r2_7_4_order_gaps", f"WITH {MS}, g AS (SELECT conv_id, seq, t, lag(seq) OVER w AS seq0, lag(t) OVER w AS time0 FROM ms WHERE seq % 50 <> 7 WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT conv_id, seq AS canonical_seq, seq0 FROM g WHERE seq <> coalesce(seq0 + 1, 0) OR t < time0")
def gaps(spark, sf):
    return timeline.order_gaps(messages(spark, sf).filter("canonical_seq % 50 <> 7")).select("conv_id", "canonical_seq", "seq0")


@query("r2_7_5_same_second", f"WITH {EV}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, sort_seq DESC) - 1 AS seq FROM (SELECT * REPLACE (t // 86400 * 86400 AS t) FROM ev)), l AS (SELECT *, lag(sort_seq) OVER (PARTITION BY conv_id, t ORDER BY seq) AS p FROM x) SELECT conv_id, message_uid FROM l WHERE sort_seq < p")
def same_second(spark, sf):
    e = views.events(spark, sf).withColumn("occurred_at_epoch_s", F.floor(F.col("occurred_at_epoch_s") / 86400) * 86400)
    w = Window.partitionBy("conv_id").orderBy("occurred_at_epoch_s", F.desc("source_sort_seq"))
    return timeline.same_second_order(e.withColumn("canonical_seq", F.row_number().over(w) - 1)).select("conv_id", "message_uid")


@query("r2_7_6_timeline_items", f"WITH {MS}, x AS (SELECT conv_id, seq, day IS DISTINCT FROM lag(day) OVER w AS new_day, (day IS DISTINCT FROM lag(day) OVER w) OR (sender <> lag(sender) OVER w) OR (t - lag(t) OVER w > 300) AS breaks FROM ms WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT conv_id, seq AS canonical_seq, new_day, breaks, sum(breaks::BIGINT) OVER (PARTITION BY conv_id ORDER BY seq)::BIGINT AS run FROM x")
def items(spark, sf):
    return timeline.timeline_items(messages(spark, sf), ZONE)


@query("r2_7_9_sample_digest", f"WITH {TU}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS r, length(text) AS n FROM tu), y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY (r > 2)::INT, CASE WHEN r > 2 THEN -n ELSE r END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so FROM x) SELECT conv_id, seq AS canonical_seq FROM y WHERE r <= 2 OR so < 600")
def digest(spark, sf):
    return timeline.sample_digest(views.turns(spark, sf), 2, 600).select("conv_id", "canonical_seq")


@query("r2_7_10_take_recent", f"WITH {TU}, x AS (SELECT conv_id, seq, sum(ceil(length(text) / 3.5)) OVER (PARTITION BY conv_id ORDER BY seq DESC) AS so FROM tu) SELECT conv_id, seq AS canonical_seq FROM x WHERE so <= 200")
def recent(spark, sf):
    return timeline.take_recent(views.turns(spark, sf).withColumn("tokens", scalars.prompt_tokens(F.col("text"))), 200).select("conv_id", "canonical_seq")


@query("r2_7_13_nth_text", f"WITH {TU} SELECT conv_id, seq AS canonical_seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n FROM tu WHERE length(text) > 0) WHERE n = 3")
def nth(spark, sf):
    return timeline.nth_text(views.turns(spark, sf), 3).select("conv_id", "canonical_seq")


CONV = "(SELECT min(conv_id) FROM ms)"


def first_conv(m):
    return m.agg(F.min("conv_id")).first()[0]


@query("r2_8_1_timeline_page", f"WITH {MS} SELECT conv_id, seq, message_uid FROM (SELECT * FROM ms WHERE conv_id = {CONV} AND seq < 40 ORDER BY seq DESC LIMIT 15)")
def page(spark, sf):
    m = messages(spark, sf)
    return timeline.timeline_page(m, first_conv(m), before=40, limit=15).select("conv_id", F.col("canonical_seq").alias("seq"), "message_uid")


@query("r2_8_2_timeline_around", f"WITH {MS} SELECT conv_id, seq, message_uid FROM ms WHERE conv_id = {CONV} AND seq BETWEEN 10 - 4 AND 10 + 5")
def around(spark, sf):
    m = messages(spark, sf)
    return timeline.timeline_around(m, first_conv(m), 10, 10).select("conv_id", F.col("canonical_seq").alias("seq"), "message_uid")


@query("r2_8_4_beyond", f"WITH {MS} SELECT min(seq) < 5 AS has_older, max(seq) > 1000000 AS has_newer FROM ms WHERE conv_id = {CONV}")
def beyond(spark, sf):
    m = messages(spark, sf)
    return timeline.beyond(m, first_conv(m), 5, 1000000)


@query("r2_8_5_offset_page", f"WITH {EV} SELECT conv_id, count(*) AS msg_count FROM ev GROUP BY conv_id ORDER BY msg_count DESC, conv_id LIMIT 10 OFFSET 5")
def offset(spark, sf):
    return timeline.offset_page(rollup(spark, sf).select("conv_id", "msg_count"), [F.desc("msg_count"), "conv_id"], 10, 5)


@query("r2_8_6_day_page", f"WITH {MS} SELECT conv_id, day, count(*) AS messages FROM ms WHERE conv_id = {CONV} GROUP BY ALL ORDER BY day DESC LIMIT 8")
def day_page(spark, sf):
    m = messages(spark, sf)
    return timeline.day_page(timeline.day_facet(m, ZONE), first_conv(m), None, 7).select("conv_id", "day", "messages")


@query("r2_8_7_message_context", f"WITH {MS}, a AS (SELECT conv_id AS c, seq AS s FROM ms WHERE message_uid = 'm100') SELECT conv_id, seq, message_uid FROM ms, a WHERE conv_id = c AND seq BETWEEN s - 5 AND s + 5")
def context(spark, sf):
    return timeline.message_context(messages(spark, sf), "m100", 5).select("conv_id", F.col("canonical_seq").alias("seq"), "message_uid")


@query("r2_8_9_pinned_first", f"WITH {EV} SELECT conv_id, max(t) AS last_time FROM ev GROUP BY conv_id")
def pinned(spark, sf):
    return timeline.pinned_first(rollup(spark, sf).select("conv_id", "last_time"), ["3", "5"])


@query("r2_9_1_union_shards", f"WITH {SH} SELECT source_db, count(*) AS row_count FROM sh GROUP BY source_db")
def union_shards(spark, sf):
    s = views.shards(spark, sf)
    parts = [s.filter(F.col("source_db") == f"message_{i}.db") for i in range(3)] + [s.filter(F.col("source_db") == "biz_message_0.db").drop("text")]
    return canonical.union_shards(parts).groupBy("source_db").agg(F.count("*").alias("row_count"))


@query("r2_9_2_all_usernames", f"WITH {EV}, {CO} SELECT username FROM co UNION SELECT conv_id FROM ev")
def usernames(spark, sf):
    return canonical.all_usernames(views.contacts(spark, sf), views.events(spark, sf).select(F.col("conv_id").alias("username")))


@query("r2_9_3_merge_pages", f"WITH {MS} SELECT message_uid, CASE WHEN seq >= 20 THEN 'b' ELSE 'a' END AS page FROM ms WHERE seq < 60")
def merge(spark, sf):
    m = messages(spark, sf).select("conv_id", "canonical_seq", "message_uid")
    return timeline.merge_pages(m.filter("canonical_seq < 40").withColumn("page", F.lit("a")), m.filter("canonical_seq between 20 and 59").withColumn("page", F.lit("b"))).select("message_uid", "page")


@query("r2_9_4_id_diff", "SELECT event_id, 'missing' AS side FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0 UNION ALL SELECT event_id, 'unexpected' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def diff(spark, sf):
    e = views.table(spark, sf, "events")
    return canonical.id_diff(e.filter("event_id % 3 = 0"), e.filter("event_id % 2 = 0"), "event_id")


@query("r2_2_1_transcripts", f"WITH {MS} SELECT conv_id, '# ' || conv_id || chr(10) || string_agg('[' || strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') || ' +08:00] ' || sender || ': ' || text, chr(10) ORDER BY seq) AS transcript FROM ms GROUP BY conv_id")
def transcripts(spark, sf):
    return timeline.transcripts(messages(spark, sf), ZONE)


@query("r2_2_3_conversation_index", f"WITH {EV} SELECT conv_id, count(*) AS msg_count, max(t) AS last_time, repeat('s', 120) AS summary FROM ev GROUP BY conv_id")
def index(spark, sf):
    return timeline.conversation_index(rollup(spark, sf).withColumn("summary", F.lit("s" * 200)))


@query("r2_2_6_bundle_manifest", f"WITH {EV}, f AS (SELECT source_db AS path, count(*) AS size, sha256(string_agg(message_uid, chr(10) ORDER BY message_uid)) AS sha256 FROM ev GROUP BY source_db) SELECT path, size, sha256, (SELECT sha256(string_agg(path || chr(9) || size || chr(9) || sha256, chr(10) ORDER BY path)) FROM f) AS bundle_digest FROM f")
def manifest(spark, sf):
    e = views.events(spark, sf)
    sizes = e.groupBy(F.col("source_db").alias("path")).agg(F.count("*").alias("size"))
    hashes = digests.ordered_digest(e, "source_db", ["message_uid"], F.col("message_uid"), "sha256").withColumnRenamed("source_db", "path")
    return sinks.bundle_manifest(sizes.join(hashes, "path"))


#: The files of a bundle, and the same after one in seven is lost, grown or changed, and one in seven is new.
VERIFY = FI + """ SELECT CASE WHEN file_id % 7 = 3 THEN '/new' ELSE '' END || path || file_id AS path,
 CASE file_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'digest' WHEN 3 THEN 'unexpected' END AS problem FROM fi WHERE file_id % 7 < 4 UNION ALL SELECT path || file_id, 'missing' FROM fi WHERE file_id % 7 = 3"""


@query("r2_2_6_verify_bundle", f"WITH {VERIFY}")
def verify(spark, sf):
    f = views.files(spark, sf).withColumn("path", F.concat("path", F.col("file_id").cast("string")))
    n = F.col("file_id") % 7
    have = f.filter(n != 0).withColumns({"size": F.when(n == 1, F.col("size") + 1).otherwise(F.col("size")), "sha256": F.when(n == 2, "other").otherwise(F.col("sha256")), "path": F.when(n == 3, F.concat(F.lit("/new"), "path")).otherwise(F.col("path"))})
    return sinks.verify_bundle(f, have)


@query("r2_13_1_build_canonical", f"WITH {SH} SELECT conv_id, source_db, local_id, row_number() OVER (PARTITION BY conv_id ORDER BY t, sort_seq, CASE adapter WHEN 'regular' THEN 0 ELSE 1 END, source_db, local_id) - 1 AS canonical_seq, strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') AS archive_day FROM dd WHERE n = 1")
def build(spark, sf):
    return canonical.build_canonical(views.shards(spark, sf), views.id_map(spark, sf), "me", ZONE)["messages"].select("conv_id", "source_db", "local_id", "canonical_seq", "archive_day")


@query("r2_13_11_list_conversations", f"WITH {EV} SELECT conv_id, count(*) AS msg_count, max(t) AS last_time FROM ev WHERE contains(conv_id, '1') GROUP BY conv_id ORDER BY last_time DESC, conv_id LIMIT 20")
def list_conversations(spark, sf):
    r = rollup(spark, sf).filter(timeline.literal_match("1", F.col("conv_id")))
    return r.select("conv_id", "msg_count", "last_time").orderBy(F.desc("last_time"), "conv_id").limit(20)


def broken(spark, sf):
    """Messages with one fault of each kind in places."""
    m = messages(spark, sf).withColumn("archive_day", scalars.archive_day(F.col("occurred_at_epoch_s"), ZONE))
    n = F.col("local_id")
    return m.withColumns({
        "type": F.when(n % 101 == 0, 2).otherwise(F.col("type")), "text": F.when(n % 103 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text")),
        "source_db": F.when(n % 107 == 0, "").otherwise(F.col("source_db")), "message_uid": F.when(n % 109 == 0, "m0").otherwise(F.col("message_uid")), "archive_day": F.when(n % 113 == 0, "2000-01-01").otherwise(F.col("archive_day")),
    })


AUDIT = MS + """, c AS (SELECT 'message-type-not-normalized' AS code, count(*) FILTER (local_id % 101 = 0) AS n FROM ms UNION ALL SELECT 'replacement-character', count(*) FILTER (local_id % 103 = 0) FROM ms
 UNION ALL SELECT 'missing-provenance', count(*) FILTER (local_id % 107 = 0) FROM ms UNION ALL SELECT 'archive-day-mismatch', count(*) FILTER (local_id % 113 = 0) FROM ms
 UNION ALL SELECT 'duplicate-message-uid', CASE WHEN count(*) FILTER (local_id % 109 = 0) > 1 THEN 1 ELSE 0 END FROM ms
 UNION ALL SELECT 'message-order-not-monotonic', 0::BIGINT UNION ALL SELECT 'same-second-source-order-mismatch', 0::BIGINT UNION ALL SELECT 'duplicate-evidence-key', 0::BIGINT UNION ALL SELECT 'duplicate-server-id', 0::BIGINT)"""


@query("r2_12_audit_messages", f"WITH {AUDIT} SELECT code, n AS count FROM c WHERE n > 0")
def audit_messages(spark, sf):
    return audit.audit_messages(broken(spark, sf), ZONE).select("code", "count")


CONV = "CAST(conv_id AS BIGINT)"


@query("r2_12_8_audit_conversations", f"""WITH {EV}, c AS (SELECT DISTINCT conv_id, {CONV} AS k FROM ev),
 o AS (SELECT k % 4 AS owner FROM c GROUP BY ALL HAVING count(DISTINCT CASE WHEN k % 4 = 1 THEN k % 8 ELSE 0 END) > 1),
 x AS (SELECT 'conversation-count-mismatch' AS code, count(*) AS count FROM c WHERE k % 10 IN (0, 3) UNION ALL SELECT 'message-order-not-monotonic', count(*) FROM c WHERE k % 10 = 5
  UNION ALL SELECT 'is-own-mismatch', count(*) FROM ev WHERE local_id % 19 = 0 UNION ALL SELECT 'duplicate-owner-snapshot', count(*) FROM o)
SELECT * FROM x WHERE count > 0""")
def audit_conversations(spark, sf):
    k = F.col("conv_id").cast("bigint")
    owner = F.concat(F.lit("o"), (k % 4).cast("string"))
    m = messages(spark, sf).withColumn("sender", F.when(F.col("local_id") % 3 == 0, owner).otherwise(F.col("sender")))
    m = m.withColumn("is_own", (F.col("sender") == owner) != (F.col("local_id") % 19 == 0))
    m = m.withColumn("canonical_seq", F.col("canonical_seq") + (k % 10 == 5).cast("int"))
    more = lambda n: (k % 10 == n).cast("int")
    convs = rollup(spark, sf).select(
        "conv_id", (F.col("msg_count") + more(0)).alias("msg_count"), (F.col("text_count") + more(3)).alias("text_count"),
        owner.alias("owner"), F.when(k % 4 == 1, k % 8).otherwise(0).alias("account"),
    )
    return audit.audit_conversations(m, convs).select("code", "count")


@query("r2_12_11_audit_references", f"""WITH {EV}, x AS (SELECT 'person-id-mismatch' AS code, count(*) AS count FROM customer WHERE c_custkey % 12 = 0
  UNION ALL SELECT 'message-person-reference-mismatch', count(*) FROM ev WHERE local_id % 5 = 1 OR local_id % 5 = 2 OR local_id % 5 = 4 OR (local_id % 5 = 0 AND {CONV} % 9 = 0)
  UNION ALL SELECT 'foreign-key-violation', (SELECT count(*) FROM ev WHERE {CONV} % 9 = 0) + (SELECT count(*) FROM ev WHERE local_id % 5 = 4) UNION ALL SELECT 'bundle-metadata-mismatch', 2)
SELECT * FROM x WHERE count > 0""")
def audit_references(spark, sf):
    """Rows by local_id modulo 5: a person as it should be; a sender without one; one without a sender; neither; a person that is not there."""
    n, i = F.col("c_name"), F.col("local_id") % 5
    made = scalars.person_id(F.lit("me"), n)
    p = views.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 12 == 0, F.concat(F.lit("x"), n)).otherwise(made).alias("person_id"), F.lit("me").alias("owner"), n.alias("username"))
    one = F.lit("Customer#000000001")
    person = scalars.person_id(F.lit("me"), one)
    m = views.events(spark, sf).withColumns({
        "sender": F.when(i.isin(2, 3), "").otherwise(one), "person_id": F.when(i.isin(0, 2), person).when(i == 4, "nobody")})
    convs = m.select("conv_id").distinct().filter("cast(conv_id as bigint) % 9 <> 0").withColumn("owner", F.lit("me"))
    run = spark.range(1).select(F.lit("r1").alias("run_id"), F.lit(2).alias("schema_version"), F.lit(ZONE).alias("time_zone"))
    said = spark.createDataFrame([("run_id", "r0"), ("schema_version", "2")], "key string, value string")
    return audit.audit_references(m, p, convs, run, said).select("code", "count")


@query("r2_12_17_audit_dependencies", "SELECT 'dependency_mismatch' AS code, count(*) AS count FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def audit_dependencies(spark, sf):
    """Products made of customers' bundles; some name an old digest, an old run, an old schema version or no parent."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    fact = lambda name, key: F.concat(F.lit(name), key)
    parents = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("kind"))
    parents = parents.select("kind", fact("run", F.col("kind")).alias("run_id"), F.lit(2).alias("schema_version"), F.md5("kind").alias("digest"))
    children = views.table(spark, sf, "orders").select(
        k.alias("product"), F.when(k % 13 != 0, c).alias("parent_kind"), F.when(k % 7 == 0, "old").otherwise(fact("run", c)).alias("parent_run"),
        F.when(k % 11 == 0, 1).otherwise(2).alias("parent_version"), F.when(k % 5 == 0, "stale").otherwise(F.md5(c)).alias("parent_digest"),
    )
    return audit.audit_dependencies(children, parents).select("code", "count")
