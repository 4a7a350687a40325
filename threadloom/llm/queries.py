"""The registered queries of the training-data operators, and their SQL where SQL can state them.

Each query reads its whole tables and takes its rows from the operator; what is done here is choosing and naming columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, compression, language_id, line_dedup, mixing, near_duplicates, packing, pieces, pii, prefix_trie, spelling, toxicity, url_filter
from .common import materialize, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, flagged for every document; the chain is fitted on labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.train_chain(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return toxicity.score_toxicity(docs, chain)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size, th = mixing.word_count(F.col("text")).alias("size"), mixing.text_digest(F.col("text")).alias("th")
    sizes = materialize(docs.select("doc_id", "source", size, th))
    return mixing.mix_sizes(sizes, sizes.count())


OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS nth FROM s),
f AS (SELECT *, source_size * 3 / w::DOUBLE AS fill, sum(source_size) OVER ()::BIGINT AS total, coalesce('=' || source, '') AS g FROM n),
t AS (SELECT *, (total - coalesce(sum(source_size) OVER (ORDER BY fill, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 3)
    / sum(w) OVER (ORDER BY fill, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level, row_number() OVER (ORDER BY fill, g) AS i FROM f),
l AS (SELECT i AS cut, level AS lv FROM t WHERE level <= fill ORDER BY i LIMIT 1),
q AS (SELECT source, source_size, nth, CASE WHEN lv IS NULL OR i < cut THEN source_size * 3.0::DOUBLE ELSE w * lv END AS target FROM t LEFT JOIN l ON TRUE),
o AS (SELECT d.doc_id, d.size, q.source_size, q.nth, q.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, CASE WHEN size > 0 AND middle <= target THEN least(floor((target - middle) / source_size) + 1, 3)::INTEGER ELSE 0 END AS copies FROM o),
u AS (SELECT *, CASE WHEN copies > 0 THEN middle / target END AS u FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  round(CASE WHEN nth = 0 THEN 2 * u / (1.5 + sqrt(greatest(1.5 * 1.5 - 2 * u, 0)))
    WHEN nth = 2 THEN 2 * u / (0.5 + sqrt(0.5 * 0.5 + 2 * u))
    WHEN u < 0.5 THEN 2 * u / (0.75 + sqrt(0.75 * 0.75 + 2 * u))
    ELSE 0.5 + 2 * (u - 0.5) / (1.25 + sqrt(greatest(1.25 * 1.25 - 2 * (u - 0.5), 0))) END, 9) AS position
FROM u
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed, removed (line numbers from 0)."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "line_dedup.*")


OP3 = r"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (
  SELECT doc_id, i AS i0, lead(i, 1) OVER p AS i1, lead(i, 2) OVER p AS i2, t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS k
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i0) AS n FROM x WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM r WHERE n > 1),
a AS (
  SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(g.i)::INTEGER AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text,
    coalesce(list(l.i ORDER BY l.i) FILTER (g.i IS NOT NULL), []) AS removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, n_removed, removed FROM a
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_captures(url_filter.capture_days(pages), url_filter.validity_intervals(url_filter.list_events(pages)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


#: crc32 as SQL: a table of 256 entries, and a fold over the bytes of a text of code points up to U+00FF.
CRC = """b AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS crc)"""
CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))), lambda y, z: xor(y >> 8, crc[(xor(y, z) & 255) + 1])))"""

OP11 = r"""
WITH RECURSIVE """ + CRC + r""",
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS times FROM r WHERE len(run) >= 5 GROUP BY ALL),
h AS (SELECT run, times, """ + CRC_OF.format("id || ':' || run") + r""" AS h FROM d, b),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % len(run))] || run[(h % len(run)) + 2:] ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM w WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
c AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM c a JOIN c b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM c a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM c a JOIN v b ON a.cut = b.word),
k AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS nth FROM p),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
  FROM v LEFT JOIN k ON v.word = k.word AND nth = 1),
t AS (SELECT word, coalesce(form, word) AS root, form AS at FROM f UNION ALL SELECT t.word, coalesce(f.form, t.root), f.form FROM t JOIN f ON t.at = f.word WHERE t.at IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word AND t.at IS NULL
"""


def piece_model() -> bytes:
    import public_tokenizers

    return pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model())
    digest = lambda c: F.sha2(c, 256)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13 = r"""
WITH """ + CRC + r""",
t AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS m, len(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
k AS (SELECT c, c - c % 100 AS base, """ + CRC_OF.format("CAST(c AS VARCHAR)") + r""" % 6 AS h FROM n, b),
s AS (SELECT k.c, base, h, least(h, coalesce(n.n, 0)) AS shared FROM k LEFT JOIN n ON k.base = n.c),
r AS (SELECT s.c, t.i AS pos, m, chars FROM s JOIN t ON s.base = t.c AND t.i < s.h UNION ALL SELECT s.c, shared + t.i - h, m, chars FROM s JOIN t ON s.c = t.c AND t.i >= s.h),
q AS (SELECT c, list(m ORDER BY pos) AS ms, list(chars ORDER BY pos) AS cs FROM r GROUP BY c),
l AS (SELECT s.c, coalesce(ms, []) AS ms, coalesce(cs, []) AS cs FROM s LEFT JOIN q ON s.c = q.c),
p AS (SELECT c, d, len(ms) AS n, array_to_string(ms[1:d], '') AS key, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM l)),
v AS MATERIALIZED (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, key),
w AS MATERIALIZED (SELECT a.*, b.conv_id AS parent_conv_id, count(*) OVER (PARTITION BY a.d, left(a.key, 32 * (a.d - 1))) AS siblings FROM v a LEFT JOIN v b ON b.d = a.d - 1 AND b.key = left(a.key, 32 * (a.d - 1)) AND a.d > 0),
x AS (SELECT DISTINCT d - 1 AS d, left(key, 32 * (d - 1)) AS key, siblings AS n_children FROM w WHERE d > 0),
y AS (SELECT w.*, coalesce(x.n_children, 0) AS n_children FROM w LEFT JOIN x ON w.d = x.d AND w.key = x.key),
z AS (SELECT e AS d, left(key, 32 * e) AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM y) GROUP BY ALL)
SELECT conv_id, y.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM y JOIN z ON y.d = z.d AND y.key = z.key
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_line_dedup, op4_language_id, op5_nearest_neighbours, op6_compression_bands, op7_url_filters, op8_packing, op9_simhash, op10_personal_data, op11_spelling, op12_pieces, op13_prefix_trie, pipeline)}
ORACLE_SQL = {"op2_mixing": OP2, "op3_line_dedup": OP3, "op7_url_filters": url_filter.ORACLE, "op11_spelling": OP11, "op13_prefix_trie": OP13}
