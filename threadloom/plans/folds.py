"""SQL twins that several query modules share."""


def chunk_sql(source, uid, most, overlap):
    """The fold of search chunks, unit by unit, over tu (conv_id, seq, sender, clock, text) of Latin texts; uid: the message_uid made of {seq} and {conv}."""
    room = most - overlap
    first, last = (uid.format(seq=f"{f}(seq)", conv="conv_id") for f in ("min", "max"))
    return f"""WITH RECURSIVE {source}, tx AS (SELECT conv_id, seq, sender, clock, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM tu),
 ps AS (SELECT conv_id, seq, sender, clock, t[i * {4 * room} + 1:i * {4 * room} + {4 * room}] AS piece, i AS part FROM (SELECT *, unnest(range(0, CAST(ceil(len(t) / {4 * room}.0) AS BIGINT))) AS i FROM tx)),
 un AS MATERIALIZED (SELECT *, CAST(ceil(len(piece) / 4.0) AS BIGINT) AS n, row_number() OVER w AS pos FROM ps WINDOW w AS (PARTITION BY conv_id ORDER BY seq, part)),
 fo AS (SELECT conv_id, pos, 0 AS i, n - {overlap} AS fill FROM un WHERE pos = 1
  UNION ALL SELECT un.conv_id, un.pos, CASE WHEN fill + n > {room} THEN i + 1 ELSE i END, CASE WHEN fill + n > {room} THEN n ELSE fill + n END FROM fo JOIN un ON fo.conv_id = un.conv_id AND un.pos = fo.pos + 1),
 pl AS MATERIALIZED (SELECT un.*, i, sum(n) OVER (PARTITION BY un.conv_id ORDER BY un.pos) AS upto FROM un JOIN fo ON un.conv_id = fo.conv_id AND un.pos = fo.pos),
 op AS (SELECT conv_id, i, min(upto - n) AS edge FROM pl WHERE i > 0 GROUP BY ALL),
 me AS (SELECT conv_id, i, pos, seq, sender, clock, piece, n FROM pl UNION ALL
  SELECT op.conv_id, op.i, pos, seq, sender, clock, CASE WHEN upto - n < edge - {overlap} THEN right(piece, CAST(4 * (upto - edge + {overlap} - 1) + 1 AS BIGINT)) ELSE piece END, least(n, upto - edge + {overlap}) FROM op JOIN pl ON op.conv_id = pl.conv_id AND upto <= edge AND upto > edge - {overlap}),
 ch AS (SELECT conv_id, i::INT AS "index", {first} AS first_uid, {last} AS last_uid, min(seq) AS first_sequence, max(seq) AS last_sequence, min(clock) AS start_time, max(clock) AS end_time,
  array_to_string(list_distinct(list(sender)).list_sort(), ',') AS senders, sum(n)::BIGINT AS token_count, string_agg(sender || ': ' || piece, chr(10) ORDER BY pos) AS text FROM me GROUP BY conv_id, i),
 ng AS (SELECT *, list_transform(regexp_extract_all(text, '(?i)[a-z0-9_:@.-]+'), lambda x: lower(x)) AS g FROM ch)
SELECT * EXCLUDE (g), sha256(conv_id || chr(10) || first_uid || chr(10) || last_uid || chr(10) || "index" || chr(10) || text) AS chunk_id,
 array_to_string(list_transform(list_sort(list_transform(list_distinct(g), lambda x: [lpad(CAST(list_position(g, x) AS VARCHAR), 9, '0'), x])), lambda x: x[2]), ' ') AS ngrams FROM ng"""
