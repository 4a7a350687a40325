"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "r2_6_2_participants"

#: The views of threadloom.sources.views, for DuckDB.
EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS conv_id, 'm' || event_id AS message_uid, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS sort_seq,
  'message_' || (event_id % 3) || '.db' AS source_db, CASE WHEN event_id % 7 = 0 THEN 'biz' ELSE 'regular' END AS adapter, event_id AS local_id,
  CASE WHEN event_id % 5 = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) END AS server_id, (event_id % 2) * 4294967296 + 1 AS raw_type, event_id % 11 AS real_sender_id, event_type AS sender, props AS text FROM events)"""
MS = EV + """, ms AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, sort_seq, CASE adapter WHEN 'regular' THEN 0 ELSE 1 END, source_db, local_id) - 1 AS seq,
  strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') AS day FROM ev)"""
SH = EV + """, sh AS (SELECT * FROM ev UNION ALL SELECT conv_id, message_uid, t, sort_seq + 1, 'biz_message_0.db', 'biz', local_id, server_id, raw_type, real_sender_id, sender, text FROM ev WHERE local_id % 10 = 3),
 dd AS (SELECT *, row_number() OVER (PARTITION BY conv_id, CASE WHEN server_id <> '0' THEN 's:' || server_id ELSE 'l:' || source_db || ':' || local_id END
   ORDER BY t, sort_seq, CASE adapter WHEN 'regular' THEN 0 ELSE 1 END, source_db, local_id) AS n FROM sh)"""
TU = "tu AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS sender, text FROM conversations)"
CH = TU + """, ch AS (SELECT conv_id || '-' || (seq // 2) AS chunk_id, conv_id, min(seq) AS first_sequence, max(seq) AS last_sequence, max(seq) * 60 AS end_time,
  list_sort(list(DISTINCT sender)) AS sender_ids, string_agg(text, chr(10) ORDER BY seq) AS text FROM tu GROUP BY conv_id, seq // 2)"""
#: The chunks, those of every fifth conversation with six letters written in Han.
HC = CH + """, hc AS (SELECT * REPLACE (CASE WHEN CAST(conv_id AS BIGINT) % 5 = 0 THEN translate(text, 'etaoin', '深度学习没有') ELSE text END AS text) FROM ch)"""
FI = """fi AS (SELECT doc_id AS file_id, source AS root, n_chars AS size, 1700000000 + doc_id * 3600 AS modified, sha256(text) AS sha256, text,
  ['txt', 'md', 'pdf', 'py', 'png', 'zip', 'dat'][doc_id % 7 + 1] AS e, 'report' || (doc_id % 50) || CASE WHEN doc_id % 3 = 0 THEN '(' || (doc_id % 4) || ')' ELSE '' END || '.' || e AS name, '.' || e AS ext,
  '/Data/' || source || '/' || lang || '/' || name AS path FROM documents)"""
CO = """co AS (SELECT c_name AS username, CASE WHEN c_custkey % 4 = 0 THEN 'remark ' || c_mktsegment ELSE ' ' END AS remark, CASE WHEN c_custkey % 3 = 0 THEN 'nick ' || c_custkey ELSE '' END AS nick,
  CASE WHEN c_custkey % 5 = 0 THEN 'alias' END AS alias FROM customer)"""
IM = "im AS (SELECT 'message_' || (c_custkey % 3) || '.db' AS source_db, c_custkey // 3 AS rowid, c_name AS user_name FROM customer)"


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


from threadloom.plans import q_library, q_messages, q_more, q_reports, q_search, q_streams  # noqa: E402, F401
