"""Queries on single checks, bounded reads by id, and late rows of streams."""

from pyspark.sql import functions as F

from threadloom.functions import rules, scalars
from threadloom.operators import assets, audit, timeline
from threadloom.plans import q_messages
from threadloom.plans.registry import FI, MS, TU, query
from threadloom.sources import views
from threadloom.sources.shared import new_path
from threadloom.streaming import streams


@query("r2_3_6_content_kind", "SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN 'text' WHEN l_returnflag = 'R' THEN 'app' WHEN l_linenumber = 3 THEN 'media' ELSE 'unknown' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def kinds(spark, sf):
    body = F.when(F.col("l_returnflag") == "R", "<appmsg>").otherwise("x")
    return views.table(spark, sf, "lineitem").groupBy("l_linenumber", scalars.content_kind(F.col("l_linenumber"), body).alias("kind")).agg(F.count("*").alias("n"))


@query("r2_3_13_table_names", "SELECT s_suppkey, 'Msg_' || md5(s_name) AS source_table, 'wx:me:' || s_name AS conv_id FROM supplier")
def names(spark, sf):
    n = F.col("s_name")
    return views.table(spark, sf, "supplier").select("s_suppkey", scalars.msg_table(n).alias("source_table"), scalars.conv_id(F.lit("me"), n).alias("conv_id"))


@query("r2_3_20_split_text", f"WITH {TU} SELECT conv_id, seq, CAST(ceil(length(text) / 80.0) AS INTEGER) AS pieces, left(text, 80) AS first FROM tu WHERE text <> ''")
def split(spark, sf):
    p = scalars.split_text(F.col("text"), 20)
    return views.turns(spark, sf).filter("text <> ''").select("conv_id", F.col("canonical_seq").alias("seq"), p.alias("p")).select("conv_id", "seq", F.size("p").alias("pieces"), F.col("p")[0].alias("first"))


@query("r2_3_24_classify_file", """SELECT doc_id,
 CASE WHEN k < 14 THEN ['AI', '比赛', '创业', '树林', '专业', '学业', '项目', '健康', '财务', '旅行', '阅读', '工具', '人物', '生活'][k + 1] WHEN e IN ('pdf', 'docx', 'csv') THEN '学业' WHEN e IN ('png', 'mp4', 'amr') THEN '过去' WHEN e = 'zip' THEN '素材' ELSE '未归类' END AS category,
 CASE WHEN k >= 14 AND e = 'zip' THEN '压缩包' WHEN k = 15 THEN '聊天影像' ELSE CASE e WHEN 'pdf' THEN '文档/PDF' WHEN 'docx' THEN '文档/文本' WHEN 'csv' THEN '文档/表格' WHEN 'png' THEN '聊天影像' WHEN 'mp4' THEN '视频' WHEN 'amr' THEN '语音' WHEN 'py' THEN '代码' ELSE '其他' END END AS subcategory
 FROM (SELECT doc_id, doc_id % 16 AS k, ['pdf', 'docx', 'csv', 'png', 'mp4', 'amr', 'zip', 'py', 'dat'][doc_id % 9 + 1] AS e FROM documents)""")
def classify(spark, sf):
    """A folder for every keyword rule, one of none and one of pictures, with every kind of file in each."""
    folders = ("Ai", "挑战杯", "resume", "forest", "病理", "期末", "roadmap", "睡眠", "发票", "酒店", "epub", "workflow", "名片", "照片", "x", "Pic")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    path = F.concat(F.lit("/D\\"), pick(folders), F.lit("/f."), pick(("pdf", "docx", "csv", "png", "mp4", "amr", "zip", "py", "dat")))
    return views.table(spark, sf, "documents").select("doc_id", rules.classify_file(path).alias("c")).select("doc_id", "c.category", "c.subcategory")


@query("r2_12_1_audit_schema", "SELECT 'schema-missing-column' AS code, 'archive_zone' AS detail")
def schema(spark, sf):
    return audit.audit_schema(views.events(spark, sf), ["text", "archive_zone"]).select("code", "detail")


@query("r2_12_3_audit_provenance", f"WITH {MS} SELECT 'missing-provenance' AS code, count(*) AS count FROM ms WHERE local_id % 107 = 0")
def provenance(spark, sf):
    return audit.audit_provenance(q_messages.broken(spark, sf)).select("code", "count")


@query("r2_12_4_audit_duplicates", f"WITH {MS} SELECT 'duplicate-message-uid' AS code, 1::BIGINT AS count WHERE (SELECT count(*) FROM ms WHERE local_id % 109 = 0) > 1")
def duplicates(spark, sf):
    return audit.audit_duplicates(q_messages.broken(spark, sf)).select("code", "count")


@query("r2_12_6_audit_types", f"WITH {MS} SELECT 'message-type-not-normalized' AS code, count(*) AS count FROM ms WHERE local_id % 101 = 0")
def types(spark, sf):
    return audit.audit_types(q_messages.broken(spark, sf)).select("code", "count")


@query("r2_12_7_audit_encoding", f"WITH {MS} SELECT 'replacement-character' AS code, count(*) AS count FROM ms WHERE local_id % 103 = 0")
def encoding(spark, sf):
    return audit.audit_encoding(q_messages.broken(spark, sf)).select("code", "count")


@query("r2_12_10_audit_canonical", f"WITH {MS} SELECT 'archive-day-mismatch' AS code, count(*) AS count FROM ms WHERE local_id % 113 = 0 UNION ALL SELECT 'canonical-message-fields-invalid', count(*) FROM ms WHERE local_id % 127 = 0")
def canonical_fields(spark, sf):
    m = q_messages.broken(spark, sf)
    return audit.audit_canonical(m.withColumn("canonical_seq", F.when(F.col("local_id") % 127 == 0, -1 - F.col("canonical_seq")).otherwise(F.col("canonical_seq"))).withColumn("source_sort_seq", F.when(F.col("local_id") % 127 == 0, -1).otherwise(F.col("source_sort_seq"))), q_messages.ZONE).select("code", "count")


@query("r2_13_13_search_artifacts", f"WITH {FI} SELECT file_id, '[文件:' || file_id || ']' AS citation FROM fi WHERE ext IN ('.pdf', '.md', '.txt') AND contains(name, 'report2') ORDER BY modified DESC, file_id LIMIT 30")
def search_artifacts(spark, sf):
    f = views.files(spark, sf).withColumns({"verified": F.lit(True), "category": assets.artifact_category(F.col("name")), "text": F.lit(""), "sender": F.lit(""), "url": F.lit("")})
    return assets.artifact_scope(f, "document", None, "report2").orderBy(F.desc("modified"), "file_id").limit(30).select("file_id", scalars.citation("file", F.col("file_id").cast("string")).alias("citation"))


@query("r2_13_14_message_context", f"WITH {MS}, a AS (SELECT conv_id AS c, seq AS s FROM ms WHERE message_uid = 'm50') SELECT message_uid, '[消息:' || message_uid || ']' AS citation FROM ms, a WHERE conv_id = c AND seq BETWEEN s - 20 AND s + 20")
def context(spark, sf):
    return timeline.message_context(q_messages.messages(spark, sf), "m50", 99).select("message_uid", scalars.citation("message", F.col("message_uid")).alias("citation"))


@query("r2_13_16_texts_by_asset", "SELECT doc_id::VARCHAR AS asset_id, left(text, 24000) AS text, coalesce(length(text) > 24000, FALSE) AS truncated FROM documents")
def texts(spark, sf):
    d = views.table(spark, sf, "documents")
    path = F.concat(F.lit("/x/"), F.col("doc_id").cast("string")).alias("path")
    ids = d.select(F.col("doc_id").cast("string").alias("asset_id"), path)
    return views.document_text(d.select(path, F.encode("text", "UTF-8").alias("content"))).join(ids, "path").select("asset_id", "text", "truncated")


LATE = """WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), c AS (SELECT floor(avg(t)) AS cut FROM e)
SELECT count(*) FILTER (t > cut) AS kept, count(*) FILTER (t <= cut) AS late FROM e, c"""


@query("r2_14_6_stream_late_counts", LATE)
def late(spark, sf):
    """The later half of the events arrives first, so rows of the earlier half are late by the watermark; the stream says how many."""
    path = new_path(spark, "stream")
    e = views.table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_uid"), F.col("ts").cast("timestamp").alias("ts"))
    cut = F.lit(e.agg(F.floor(F.avg(F.unix_timestamp("ts")))).first()[0])
    # Late rows are told by the watermark of the batch before the last, hence two batches of the later half.
    later = F.unix_timestamp("ts") > cut
    odd = F.crc32(F.col("message_uid").cast("binary")) % 2 == 1
    for part in (later & odd, later & ~odd, ~later):
        e.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = streams.stream_dedup(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), "1 hour")
    q = s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{path}/out")).start()
    q.awaitTermination()
    kept = spark.read.parquet(f"{path}/out").count()
    return spark.createDataFrame([(kept, streams.late_counts(q))], "kept long, late long")
