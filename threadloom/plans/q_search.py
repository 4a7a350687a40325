"""Queries on search, vectors, links and insights."""

from pyspark.sql import functions as F

from threadloom.functions import rules, scalars
from threadloom.operators import assets, insights, search, timeline
from threadloom.plans.folds import chunk_sql
from threadloom.plans.q_messages import ZONE, messages
from threadloom.plans.registry import CH, EV, HC, MS, TU, query
from threadloom.sources import views
from threadloom.sources.shared import new_path

#: Two phrases of two tokens, an identifier and a Han word, and the terms and phrases that the index makes of them.
Q = "of_the please 度没习 Que.la"
WANTED = "(0, 0, '度没', 1), (1, 0, '没习', 1), (2, 0, '度没习', 1), (3, 0, 'of', 2), (3, 1, 'the', 2), (4, 0, 'please', 1), (5, 0, 'que', 2), (5, 1, 'la', 2)"
TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
GRAMS = """array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: [lpad(CAST(list_position(w, x) AS VARCHAR), 9, '0'), x])), lambda x: x[2]), ' ')"""
PO = HC + f""", gr AS (SELECT chunk_id, text, list_concat(flatten(list_transform(regexp_extract_all(text, '\\p{{Han}}+'), lambda r: list_concat(
   list_transform(range(1, len(r)), lambda i: r[i:i + 1]), list_transform(range(1, len(r) - 1), lambda i: r[i:i + 2])))), list_transform(regexp_extract_all(text, '(?i)[a-z0-9_:@.-]+'), lambda x: lower(x))) AS w FROM hc),
 ft AS (SELECT chunk_id, 'text' AS field, {TOKENS.format('text')} AS ts FROM hc UNION ALL SELECT chunk_id, 'ngrams', {TOKENS.format(GRAMS)} FROM gr),
 tk AS (SELECT chunk_id, field, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM ft), po AS (SELECT term, chunk_id, field, count(*) AS tf FROM tk GROUP BY ALL),
 ln AS (SELECT chunk_id, count(*) AS len FROM tk GROUP BY chunk_id), st AS (SELECT (SELECT count(*) FROM hc) AS n, (SELECT count(*) FROM tk) AS total),
 mt AS (SELECT phrase, chunk_id, field, size FROM tk JOIN (VALUES {WANTED}) AS w (phrase, o, term, size) USING (term) GROUP BY phrase, chunk_id, field, size, pos - o HAVING count(*) = size),
 ht AS (SELECT phrase, chunk_id, sum(CASE WHEN field = 'ngrams' THEN 0.45::DOUBLE ELSE 1 END) AS f FROM mt GROUP BY phrase, chunk_id), df AS (SELECT phrase, count(*) AS df FROM ht GROUP BY phrase),
 bm AS (SELECT chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (total / n)))) AS score FROM ht JOIN df USING (phrase) JOIN ln USING (chunk_id), st GROUP BY chunk_id)"""
TERMS = "SELECT chunk_id, 1.0 AS score FROM bm JOIN hc USING (chunk_id) WHERE {scope} ORDER BY round(bm.score, 9) DESC, conv_id, last_sequence DESC, chunk_id LIMIT {most}"


def chunk_index(spark, sf):
    return search.build_index(views.han_chunks(spark, sf))


def vectors(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark, sf):
    return list(vectors(spark, sf).filter("chunk_id = 7").first()["vector"])


COS = """cv AS (SELECT e.vec_id AS chunk_id, e.label, 1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS d
 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"""


@query("r2_4_2_search_scope", f"WITH {CH} SELECT chunk_id FROM ch WHERE list_contains(sender_ids, 'user') AND end_time >= 120 AND first_sequence * 60 <= 600")
def scope(spark, sf):
    c = views.chunks(spark, sf).withColumn("start_time", F.col("first_sequence") * 60)
    return search.search_scope(c, None, "user", 120, 600).select("chunk_id")


@query("r2_10_2_postings", f"WITH {PO} SELECT term, chunk_id, field, tf, len::INT AS len, positions FROM po JOIN ln USING (chunk_id) JOIN (SELECT term, chunk_id, field, array_to_string(list_sort(list(pos)), ' ') AS positions FROM tk GROUP BY ALL) USING (term, chunk_id, field)")
def build(spark, sf):
    return search.build_postings(views.han_chunks(spark, sf)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query("r2_10_3_exact_search", f"WITH {CH} SELECT chunk_id, end_time FROM ch WHERE contains(lower(text), 'the') ORDER BY end_time DESC, conv_id, last_sequence DESC, chunk_id LIMIT 40")
def exact(spark, sf):
    return search.exact_search(views.chunks(spark, sf), "the", 10).select("chunk_id", "end_time")


@query("r2_10_4_bm25", f"WITH {PO} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25(spark, sf):
    """On the stored index: written once, read by bucket."""
    index = search.write_index(views.han_chunks(spark, sf), new_path(spark, "index"))
    return search.bm25(index, search.query_phrases(spark, Q)).select("chunk_id", F.round("score", 6).alias("score"))


KEYWORDS = """ex AS (SELECT chunk_id, 2.0 AS score FROM hc WHERE contains(lower(text), lower('{q}')) AND {scope} ORDER BY end_time DESC, conv_id, last_sequence DESC, chunk_id LIMIT {most}),
 tm AS ({terms}),
 al AS (SELECT chunk_id, max(score)::DOUBLE AS score FROM (SELECT * FROM ex UNION ALL SELECT * FROM tm) GROUP BY chunk_id),
 kw AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM al ORDER BY score DESC, chunk_id LIMIT {limit})"""


def keywords(scope, limit):
    return KEYWORDS.format(q=Q, scope=scope, limit=limit, most=4 * limit, terms=TERMS.format(scope=scope, most=4 * limit))


@query("r2_10_5_keyword_search", f"WITH {PO}, {keywords('TRUE', 20)} SELECT chunk_id, score, rank::INT AS rank FROM kw")
def keyword(spark, sf):
    return search.keyword_search(views.han_chunks(spark, sf), chunk_index(spark, sf), Q, 20)


@query("r2_10_6_validate_vectors", "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'dimension' ELSE 'zero' END AS problem FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0")
def validate(spark, sf):
    v = F.when(F.col("chunk_id") % 7 == 0, F.slice("vector", 1, 3)).when(F.col("chunk_id") % 11 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    return search.validate_vectors(vectors(spark, sf).withColumn("vector", v), 64)


@query("r2_10_7_vector_search", f"WITH {COS}, n AS (SELECT * FROM cv ORDER BY d, chunk_id LIMIT 80) SELECT chunk_id, round(1 - d, 6) AS score FROM n WHERE label % 2 = 0 ORDER BY d, chunk_id LIMIT 10")
def vector(spark, sf):
    return search.vector_search(vectors(spark, sf), query_vector(spark, sf), 10, F.col("label") % 2 == 0).select("chunk_id", F.round("score", 6).alias("score"))


@query("r2_10_8_rrf", """WITH l AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings UNION ALL SELECT vec_id, row_number() OVER (ORDER BY (vec_id * 7919) % 1009, vec_id) FROM embeddings)
SELECT chunk_id, round(sum(1 / (60.0 + rank)), 9) AS score, min(rank)::INT AS best FROM l GROUP BY chunk_id ORDER BY sum(1 / (60.0::DOUBLE + rank)) DESC, best, chunk_id LIMIT 30""")
def rrf(spark, sf):
    v = vectors(spark, sf).select("chunk_id")
    a = search.ranked(v, F.floor(F.col("chunk_id") / 10_000), "chunk_id")
    b = search.ranked(v, F.col("chunk_id") * 7919 % 1009, "chunk_id")
    return search.rrf([a, b], 30).select("chunk_id", F.round("score", 9).alias("score"), "best")


@query("r2_10_10_live_search", f"WITH {MS} SELECT conv_id, seq AS canonical_seq, message_uid FROM ms WHERE contains(lower(text), '5') AND sender = 'click' AND t >= (SELECT min(t) + 86400 FROM ms) ORDER BY t DESC, conv_id, seq DESC LIMIT 50")
def live(spark, sf):
    m = messages(spark, sf)
    after = m.agg(F.min("occurred_at_epoch_s")).first()[0] + 86400
    return search.live_search(m, "5", 50, sender="click", after=after).select("conv_id", "canonical_seq", "message_uid")


@query("r2_10_11_index_status", f"WITH {CH} SELECT CASE WHEN (SELECT count(*) FROM ch) <> (SELECT count(*) FROM embeddings) THEN 'invalid' ELSE 'ready' END AS status, 'hybrid' AS mode")
def status(spark, sf):
    meta = spark.range(1).select(F.lit("f").alias("fingerprint"))
    return search.index_status(views.chunks(spark, sf), vectors(spark, sf), meta, "f")


@query("r2_10_12_public_hits", f"WITH {CH} SELECT chunk_id, left(text, 4000) AS text, '[消息:' || chunk_id || ']' AS citation FROM ch")
def hits(spark, sf):
    return search.public_hits(views.chunks(spark, sf))


@query("r2_10_1_chunk_messages", chunk_sql("tu AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, 60 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS clock, role AS sender, text FROM conversations)", "{conv} || '-' || {seq}", 800, 80))
def chunk(spark, sf):
    t = views.turns(spark, sf).withColumns({"message_uid": F.concat_ws("-", "conv_id", F.col("canonical_seq").cast("string")), "occurred_at_epoch_s": F.col("canonical_seq") * 60})
    return search.chunk_messages(t).withColumn("senders", F.array_join(F.array_sort("sender_ids"), ",")).drop("sender_ids")


FUSED = """, nn AS (SELECT cv.chunk_id // 3 || '-' || cv.chunk_id % 3 AS chunk_id, d FROM cv), nv AS (SELECT * FROM nn WHERE {near} ORDER BY d, chunk_id LIMIT 80),
 vs AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS rank FROM nv ORDER BY d, chunk_id LIMIT 10),
 fu AS (SELECT chunk_id, sum(1 / (60.0::DOUBLE + rank)) AS score, min(rank) AS best FROM (SELECT chunk_id, rank FROM kw UNION ALL SELECT * FROM vs) GROUP BY chunk_id)"""
TOP = " ORDER BY score DESC, best, conv_id NULLS LAST, last_sequence DESC NULLS LAST, chunk_id LIMIT 10"
USER = "list_contains(sender_ids, 'user')"


def chunk_vectors(spark, sf):
    """The embeddings as the vectors of the first three chunks of conversations; some chunks have none, and some are of none."""
    n = F.col("chunk_id")
    name = F.concat_ws("-", F.floor(n / 3).cast("string"), (n % 3).cast("string"))
    return vectors(spark, sf).select(name.alias("chunk_id"), "vector")


@query("r2_10_9_hybrid_search", f"WITH {PO}, {COS}, {keywords('TRUE', 10)} {FUSED.format(near='TRUE')} SELECT chunk_id, round(score, 9) AS score, best::INT AS best FROM fu LEFT JOIN hc USING (chunk_id){TOP}")
def hybrid(spark, sf):
    got, why = search.hybrid_search(views.han_chunks(spark, sf), chunk_index(spark, sf), Q, 10, chunk_vectors(spark, sf), query_vector(spark, sf), 64)
    assert why is None
    return got.select("chunk_id", F.round("score", 9).alias("score"), "best")


# Links and files.

PR = MS + """, pr AS (SELECT local_id AS resource_id, CASE WHEN local_id % 4 = 0 THEN message_uid END AS message_uid, conv_id AS chat_table, CASE WHEN local_id % 3 = 0 THEN local_id END AS local_id,
  CASE WHEN local_id % 5 = 1 THEN server_id END AS server_id, CASE WHEN local_id % 30 = 0 THEN t + 1 ELSE t END AS create_time FROM ms WHERE local_id % 2 = 0)"""


def probes(spark, sf):
    m = messages(spark, sf).filter("local_id % 2 = 0")
    n = F.col("local_id")
    return m.select(
        n.alias("resource_id"), F.when(n % 4 == 0, F.col("message_uid")).alias("message_uid"), F.col("conv_id").alias("chat_table"), F.when(n % 3 == 0, n).alias("local_id"),
        F.when(n % 5 == 1, F.col("server_id")).alias("server_id"), F.when(n % 30 == 0, F.col("occurred_at_epoch_s") + 1).otherwise(F.col("occurred_at_epoch_s")).alias("create_time"),
    )


def targets(spark, sf):
    return messages(spark, sf).select("message_uid", F.col("conv_id").alias("chat_table"), "local_id", "server_id", F.col("occurred_at_epoch_s").alias("create_time"))


@query("r2_5_4_message_candidates", f"WITH {PR} SELECT DISTINCT resource_id, ms.message_uid AS candidate_uid FROM pr JOIN ms ON pr.message_uid = ms.message_uid OR (pr.chat_table = ms.conv_id AND pr.local_id = ms.local_id) OR (pr.chat_table = ms.conv_id AND nullif(pr.server_id, '0') = nullif(ms.server_id, '0'))")
def candidates(spark, sf):
    return assets.message_candidates(probes(spark, sf), targets(spark, sf))


@query("r2_5_5_align_resources", f"WITH {PR}, j AS (SELECT pr.*, (pr.message_uid IS NOT NULL OR pr.local_id IS NOT NULL OR nullif(pr.server_id, '0') IS NOT NULL) AS found FROM pr) SELECT resource_id, CASE WHEN NOT found THEN 'missing' WHEN resource_id % 30 = 0 THEN 'conflict' WHEN message_uid IS NULL OR local_id IS NULL OR server_id IS NULL THEN 'partial' ELSE 'exact' END AS verdict, found::BIGINT AS candidates FROM j")
def align(spark, sf):
    return assets.align_resources(probes(spark, sf), targets(spark, sf), ("message_uid", "chat_table", "local_id", "server_id", "create_time")).select("resource_id", "verdict", "candidates")


@query("r2_5_6_align_voice", f"WITH {EV} SELECT local_id AS voice_id, CASE WHEN local_id % 3 = 2 THEN 'missing' WHEN local_id % 10 = 7 THEN 'conflict' ELSE 'unique' END AS status FROM ev WHERE local_id % 2 = 1")
def voice(spark, sf):
    m = messages(spark, sf).withColumn("type", F.lit(34))
    n = F.col("local_id")
    v = m.filter("local_id % 2 = 1").select(n.alias("voice_id"), "conv_id", F.when(n % 3 == 2, -n).otherwise(n).alias("local_id"), F.lit(None).cast("string").alias("server_id"), F.when(n % 10 == 7, 0).otherwise(F.col("occurred_at_epoch_s")).alias("occurred_at_epoch_s"))
    return assets.align_voice(v, m).select("voice_id", "status")


@query("r2_11_2_confirm_link", f"WITH {PR}, j AS (SELECT resource_id, CASE WHEN resource_id % 30 = 0 THEN 'alignment_conflict' WHEN resource_id % 8 = 0 THEN 'evidence_differs' END AS reason FROM pr) SELECT resource_id, reason, reason IS NULL AS confirmed FROM j")
def confirm(spark, sf):
    p = probes(spark, sf).select("resource_id", F.when(F.col("resource_id") % 30 == 0, "conflict").otherwise("exact").alias("verdict"), F.lit("c").alias("message_conv"), F.lit("c").alias("resource_conv"), F.lit("e").alias("message_evidence"), F.when(F.col("resource_id") % 8 == 0, "f").otherwise("e").alias("resource_evidence"))
    return assets.confirm_link(p).select("resource_id", "reason", "confirmed")


@query("r2_11_4_link_artifacts", r"""WITH u AS (SELECT page_id, list_transform(regexp_extract_all(html || ' ' || url || ', ' || url, '(?i)https?://[^\s<>"''`，。！？；：、（）【】《》「」『』]+'), lambda x: regexp_replace(x, '[.,;:!?)\]}]+$', '')) AS us FROM pages),
 d AS (SELECT page_id, list_distinct(list_transform(us, lambda x: x || CASE WHEN regexp_matches(x, '^https?://[^/]+$') THEN '/' ELSE '' END)) AS us FROM u) SELECT page_id, unnest(us) AS url FROM d""")
def links(spark, sf):
    p = views.table(spark, sf, "pages").select(F.col("page_id").alias("message_uid"), F.concat("html", F.lit(" "), "url", F.lit(", "), "url").alias("text"))
    return assets.link_artifacts(p).select(F.col("message_uid").alias("page_id"), "url")


@query("r2_3_34_public_url", r"SELECT page_id, regexp_matches(url, '^https?://') AND page_id % 3 <> 0 AS public FROM pages")
def public(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://192.168."), (F.col("page_id") % 250).cast("string"), F.lit(".1/x"))).otherwise(F.col("url"))
    return views.table(spark, sf, "pages").select("page_id", scalars.is_public_url(u).alias("public"))


# Insights, on turns with a Latin rule table.

LATIN = (("table", "table"), ("ask", "please|question"), ("code", "code|python"))
SCORE = "least(length(text), 180) + CASE WHEN regexp_matches(text, '(?i)please') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)table|please|question|code|python') THEN 30 ELSE 0 END"
NU = TU + f""", sc AS (SELECT *, {SCORE} AS score, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tx FROM tu), el AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, seq) AS rank FROM sc WHERE length(tx) >= 12 AND NOT regexp_matches(tx, '(?i)^https?://\\S+$')),
 nu AS (SELECT conv_id, seq AS canonical_seq, rank, CASE WHEN regexp_matches(tx, '(?i)table') THEN 'table' WHEN regexp_matches(tx, '(?i)please|question') THEN 'ask' WHEN regexp_matches(tx, '(?i)code|python') THEN 'code' ELSE '其他' END AS category, score, greatest(1, least(5, floor(score / 50.0 + 0.5)))::INT AS importance,
  CASE WHEN length(tx) <= 140 THEN tx ELSE left(tx, 139) || '…' END AS content FROM el WHERE rank <= 5)"""


def nuggets(spark, sf):
    return insights.top_nuggets(views.turns(spark, sf), 5, LATIN, "please")


@query("r2_7_7_top_nuggets", f"WITH {NU} SELECT conv_id, canonical_seq, rank::INT AS rank, category, score::INT AS score, importance, content FROM nu")
def top(spark, sf):
    return nuggets(spark, sf).drop("title")


@query("r2_4_5_distillable", f"WITH {TU} SELECT conv_id, seq FROM tu WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 12 AND NOT regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)^https?://\\S+$')")
def distillable(spark, sf):
    return views.turns(spark, sf).filter(rules.distillable(F.col("text"))).select("conv_id", F.col("canonical_seq").alias("seq"))


@query("r2_2_4_insight_boards", f"WITH {NU}, tp AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY importance DESC, score DESC, conv_id, canonical_seq) AS n FROM nu) SELECT category, count(*) AS nuggets FROM tp WHERE n <= 36 GROUP BY category")
def boards(spark, sf):
    b = insights.insight_boards(nuggets(spark, sf))
    return b.select("category", F.size(F.filter(F.split("board", "\n"), lambda x: x.startswith("- "))).cast("long").alias("nuggets"))


@query("r2_6_16_insights_response", f"WITH {NU} SELECT category, count(*) AS nuggets, count(DISTINCT conv_id) AS conversations FROM nu GROUP BY category")
def response(spark, sf):
    return insights.insights_response(nuggets(spark, sf)).drop("top")


ST = "st AS (SELECT conv_id, CASE WHEN CAST(conv_id AS BIGINT) % 3 = 1 THEN n ELSE n - 5 END AS done FROM (SELECT conv_id, count(*) AS n FROM ev GROUP BY conv_id) WHERE CAST(conv_id AS BIGINT) % 3 <> 0)"


def states(spark, sf):
    m = messages(spark, sf)
    n = m.groupBy("conv_id").agg(F.count("*").alias("n")).filter("cast(conv_id as bigint) % 3 <> 0")
    return m, n.select("conv_id", F.when(F.col("conv_id").cast("bigint") % 3 == 1, F.col("n")).otherwise(F.col("n") - 5).alias("analyzed_text_count"))


@query("r2_5_10_plan_delta", f"WITH {EV}, {ST}, c AS (SELECT conv_id, count(*) AS n FROM ev GROUP BY conv_id) SELECT conv_id, n - coalesce(done, 0) AS growth, CASE WHEN done IS NULL THEN 'new' WHEN n - done >= 4 THEN 'grown' WHEN n > done THEN 'accumulated' ELSE 'unchanged' END AS plan FROM c LEFT JOIN st USING (conv_id)")
def delta(spark, sf):
    m, s = states(spark, sf)
    return insights.plan_delta(m.groupBy("conv_id").agg(F.count("*").alias("text_count")), s, 4)


@query("r2_5_16_bind_cursors", f"WITH {MS}, {ST} SELECT st.conv_id, ms.seq AS cursor_seq FROM st JOIN ms ON st.conv_id = ms.conv_id AND ms.seq = done - 1")
def cursors(spark, sf):
    m, s = states(spark, sf)
    at = s.join(m, "conv_id").filter("canonical_seq = analyzed_text_count - 1").select("conv_id", "analyzed_text_count", F.col("message_uid").alias("analyzed_last_message_uid"))
    return insights.bind_cursors(at, m).select("conv_id", "cursor_seq")


@query("r2_13_2_refresh_insights", f"WITH {MS}, {ST}, c AS (SELECT conv_id, count(*) AS n FROM ms GROUP BY conv_id) SELECT conv_id, CASE WHEN done IS NULL OR n - done >= 4 THEN n ELSE done END AS analyzed_text_count FROM c LEFT JOIN st USING (conv_id)")
def refresh(spark, sf):
    m, s = states(spark, sf)
    at = s.join(m, "conv_id").filter("canonical_seq = analyzed_text_count - 1").select("conv_id", "analyzed_text_count", F.col("message_uid").alias("analyzed_last_message_uid"))
    return insights.refresh_insights(m, m.groupBy("conv_id").agg(F.count("*").alias("text_count")), at, 4)[1].select("conv_id", "analyzed_text_count")


@query("r2_2_5_delta_digests", f"WITH {TU} SELECT conv_id, left('# ' || conv_id || chr(10) || string_agg(sender || ': ' || text, chr(10) ORDER BY seq), 500) AS digest FROM tu GROUP BY conv_id")
def digests(spark, sf):
    return insights.delta_digests(views.turns(spark, sf), 500)


@query("r2_7_8_preferred_state", f"WITH {EV}, x AS (SELECT conv_id, sender AS username, max(t) AS last_time, count(*) AS text_count FROM ev GROUP BY ALL) SELECT username, conv_id, last_time FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY last_time DESC, text_count DESC, conv_id) AS n FROM x) WHERE n = 1")
def preferred(spark, sf):
    s = messages(spark, sf).groupBy("conv_id", F.col("sender").alias("username")).agg(F.max("occurred_at_epoch_s").alias("last_time"), F.count("*").alias("text_count")).withColumn("analyzed_at", F.lit(0))
    return insights.preferred_state(s).select("username", "conv_id", "last_time")


@query("r2_5_11_reconcile_insights", "SELECT c_custkey AS conv_id, c_custkey + 1000000 AS legacy_id FROM customer WHERE c_custkey % 4 <> 0")
def reconcile(spark, sf):
    c = views.table(spark, sf, "customer")
    cur = c.select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("username"))
    old = c.select((F.col("c_custkey") + 1000000).alias("legacy_id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 4 != 0).alias("owner_ok"))
    return insights.reconcile_insights(cur, old)


@query("r2_9_5_merge_insights", f"WITH {EV} SELECT conv_id, string_agg(sender, ',' ORDER BY sender) AS items FROM (SELECT DISTINCT conv_id, sender FROM ev) GROUP BY conv_id")
def merge(spark, sf):
    return insights.merge_insights(views.events(spark, sf).select("conv_id", F.col("sender").alias("item")))


@query("r2_13_15_timeline_slice", f"WITH {MS}, s AS (SELECT * FROM ms WHERE conv_id = (SELECT min(conv_id) FROM ms) AND sender = 'click') SELECT message_uid, seq AS canonical_seq FROM s ORDER BY seq DESC LIMIT 12")
def slice_(spark, sf):
    m = messages(spark, sf)
    return timeline.timeline_page(m, m.agg(F.min("conv_id")).first()[0], limit=12, sender="click").select("message_uid", "canonical_seq")


@query("r2_13_9_chat_digests", f"""WITH {MS}, o AS (SELECT *, seq >= 20 AS late, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY seq >= 20, CASE WHEN seq >= 20 THEN -length(text) ELSE seq END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so FROM ms)
 SELECT conv_id, count(*) AS messages, min(day) AS first_day, sum(length(text))::BIGINT AS chars, sum(seq)::BIGINT AS places FROM o WHERE NOT late OR so < 800 GROUP BY conv_id""")
def chat_digests(spark, sf):
    d = timeline.sample_digest(messages(spark, sf), 20, 800).withColumn("day", scalars.archive_day(F.col("occurred_at_epoch_s"), ZONE))
    return d.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("day").alias("first_day"), F.sum(F.length("text")).alias("chars"), F.sum("canonical_seq").alias("places"))
