"""A stored index of search chunks: positions of every token, and BM25 over terms and phrases.

Postings lie in buckets by their term's hash, sorted by term, so a query reads the buckets of its own terms only. A chunk's length stands in
each of its postings, so that scoring joins nothing that grows with the corpus.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import scalars

K1, B, NGRAM_WEIGHT, LEAST_IDF = 1.2, 0.75, 0.45, 1e-6
TOKEN = r"[\p{L}\p{M}\p{N}]+"
#: Buckets of the postings, and parts that the rows of one bucket are written in.
BUCKETS, PARTS = 64, 8


def _bases() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters they are without them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, b) for c, b in pairs if b.isascii() and b.islower() and c != b]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _bases()


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case, without diacritics."""
    low = F.lower(c)
    bare = F.regexp_replace(F.translate(low, MARKED, PLAIN), r"[\x{300}-\x{36F}]", "")
    marked = r"[\x{C0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}]"
    return F.regexp_extract_all(F.when(low.rlike(marked), bare).otherwise(low), F.lit(TOKEN), F.lit(0))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """postings: bucket, term, chunk_id, field, tf, positions, len; stats: one row, n chunks and their tokens in total."""

    postings: DataFrame
    stats: DataFrame
    buckets: int


def _tokenized(chunks: DataFrame) -> DataFrame:
    """chunk_id, t, g, len: the tokens of both fields, and how many they are. N-grams are made where chunks have none."""
    grams = F.col("ngrams") if "ngrams" in chunks.columns else F.array_join(scalars.ngrams(F.col("text")), " ")
    some = lambda c: F.coalesce(tokens(c), F.array().cast("array<string>"))
    return chunks.select("chunk_id", some(F.col("text")).alias("t"), some(grams).alias("g")).withColumn("len", F.size("t") + F.size("g"))


def build_postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, field (text or ngrams), tf, positions, len (tokens of the chunk in both fields)."""
    fields = F.array(F.struct(F.lit("text").alias("field"), F.col("t").alias("of")), F.struct(F.lit("ngrams").alias("field"), F.col("g").alias("of")))
    both = _tokenized(chunks).select("chunk_id", "len", F.explode(fields).alias("f"))
    each = both.select("chunk_id", "len", "f.field", F.posexplode("f.of").alias("pos", "term"))
    return each.groupBy("term", "chunk_id", "field").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))


def build_index(chunks: DataFrame, buckets: int = BUCKETS) -> TextIndex:
    """The index of chunks (chunk_id, text, perhaps ngrams), not stored: a query makes the postings of its own terms."""
    postings = build_postings(chunks).withColumn("bucket", bucket_of(F.col("term"), buckets))
    return TextIndex(postings, _tokenized(chunks).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")), buckets)


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
    """Store the index below path: postings in folders by bucket, each in a few files sorted by term, and the statistics."""
    made = build_index(chunks, buckets)
    parts = made.postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
    parts.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = chunks.sparkSession
    total = spark.read.schema(made.postings.schema).parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = chunks.agg(F.count("*").alias("n")).crossJoin(total)  # one row each
    stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/stats")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    stats = spark.read.parquet(f"{path}/stats")
    schema = "term string, chunk_id string, field string, tf long, positions array<int>, len int, bucket int"
    return TextIndex(spark.read.schema(schema).parquet(f"{path}/postings"), stats.select("n", "total"), stats.first()["buckets"])


def query_phrases(spark: SparkSession, q: str) -> list[list[str]]:
    """The phrases of a query, each a list of tokens: its n-grams and identifiers, as the index cuts them. A query holds 500 characters at most."""
    found = spark.range(1).select(F.transform(scalars.ngrams(F.lit(q)), tokens).alias("p")).first()["p"]
    return [p for p in found if p]


def phrase_hits(index: TextIndex, phrases: list[list[str]]) -> DataFrame:
    """phrase (its number), chunk_id, f (weighted occurrences), len. The tokens of a phrase stand side by side in one field."""
    spark = index.postings.sparkSession
    rows = [(i, n, t, len(p)) for i, p in enumerate(phrases) for n, t in enumerate(p)]
    wanted = spark.createDataFrame(rows, "phrase int, offset int, term string, size int")
    terms = sorted({t for p in phrases for t in p})
    buckets = [r["b"] for r in wanted.select(bucket_of(F.col("term"), index.buckets).alias("b")).distinct().collect()]
    found = index.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).join(F.broadcast(wanted), "term")  # as many rows as the query has tokens
    single = found.filter("size = 1").select("phrase", "chunk_id", "field", F.col("tf").alias("times"), "len")
    starts = F.transform("positions", lambda p: p - F.col("offset")).alias("starts")
    lists = found.filter("size > 1").select("phrase", "size", "chunk_id", "field", "len", starts).groupBy("phrase", "size", "chunk_id", "field").agg(F.collect_list("starts").alias("lists"), F.first("len").alias("len"))
    whole = lists.filter(F.size("lists") == F.col("size"))
    shared = F.aggregate(F.slice("lists", 2, F.col("size")), F.col("lists")[0], F.array_intersect)
    multi = whole.select("phrase", "chunk_id", "field", F.size(shared).cast("long").alias("times"), "len").filter("times > 0")
    weight = F.when(F.col("field") == "ngrams", NGRAM_WEIGHT).otherwise(1.0)
    return single.union(multi).groupBy("phrase", "chunk_id").agg(F.sum(F.col("times") * weight).alias("f"), F.first("len").alias("len"))


def bm25(index: TextIndex, phrases: list[list[str]], within: DataFrame | None = None) -> DataFrame:
    """chunk_id, score: chunks with any of the phrases; frequencies weighted by field, lengths over both fields.

    Only chunks of within (chunk_id) are scored, if it is given; what is rare is counted over all chunks all the same.
    """
    hits = phrase_hits(index, phrases)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    if within is not None:
        hits = hits.join(within.select("chunk_id"), "chunk_id", "left_semi")
    n, avg = F.col("n"), F.col("total") / F.col("n")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / avg))
    rows = hits.join(F.broadcast(df), "phrase").crossJoin(index.stats)  # df has a row a phrase, stats one
    return rows.groupBy("chunk_id").agg(F.sum(part).alias("score"))

