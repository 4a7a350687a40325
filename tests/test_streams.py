"""Streams fed file by file against the batch result on the whole input."""

import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import chunks, timeline
from threadloom.plans.q_streams import drain, rocksdb
from threadloom.streaming import streams


@pytest.fixture(scope="module")
def fed(spark, sf, tmp_path_factory):
    """Messages in four files in order of time, the first file's rows once more in the second."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("conv_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_uid"), F.col("event_id").alias("canonical_seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"))
    cuts = e.approxQuantile("canonical_seq", [0.25, 0.5, 0.75], 0.0)
    part = sum((F.col("canonical_seq") > c).cast("int") for c in cuts)
    for i in range(4):
        e.filter(part == i).coalesce(1).write.mode("append").parquet(path)
        if i == 1:
            e.filter(part == 0).coalesce(1).write.mode("append").parquet(path)
    return e, lambda n=1: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", n).parquet(path)


def test_dedup_equals_batch(fed):
    e, stream = fed
    got = drain(streams.stream_dedup(stream(), "60 days"), "append")
    assert got.count() == e.count() == got.select("message_uid").distinct().count()


def test_days_equal_batch(fed):
    e, stream = fed
    once = drain(streams.stream_days(stream(), "60 days", 8), "complete")
    both = e.unionByName(e.filter(F.col("canonical_seq") <= e.approxQuantile("canonical_seq", [0.25], 0.0)[0]))
    want = both.groupBy("conv_id", scalars.archive_day(F.unix_timestamp("ts"), "Asia/Shanghai").alias("day")).agg(F.count("*").alias("messages"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_keep_the_gap_and_break_past_it(spark, tmp_path):
    rows = [("c", 0), ("c", 300), ("c", 601), ("d", 0)]
    df = spark.createDataFrame(rows, "conv_id string, t long").select("conv_id", F.timestamp_seconds("t").alias("ts"))
    for i in range(2):
        df.filter(F.unix_timestamp("ts") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drain(streams.stream_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 day", 300), "complete")
    assert sorted(map(tuple, got.collect())) == [("c", 0, 300, 2), ("c", 601, 601, 1), ("d", 0, 0, 1)]


def test_delta_accumulates_small_growth(fed):
    e, stream = fed
    got = drain(streams.stream_delta(stream(), 8), "append").groupBy("conv_id").agg(F.sum("growth").alias("g"), F.max("total").alias("t"), F.min("growth").alias("low")).collect()
    first = e.approxQuantile("canonical_seq", [0.25], 0.0)[0]
    whole = {r.conv_id: r.n for r in e.unionByName(e.filter(F.col("canonical_seq") <= first)).groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert got and all(r.g == r.t and r.low >= 8 and 0 <= whole[r.conv_id] - r.t < 8 for r in got)


def test_chunks_equal_batch(spark, tmp_path):
    """Five files out of order within the delay, null and blank texts, long ones, a row that is late, and a last time that closes all."""
    rng = random.Random(8)
    rows = []
    for c in ("p", "q", None):
        for i in range(60):
            text = rng.choice(["深度学习 ", "plan_a ", "x"]) * rng.randrange(1, 12)
            rows.append((c, i, f"{c}-{i}", rng.choice(["ann", "bob", None]), 1000 * i + 1000, rng.choice([text, text, None, " "])))
    schema = "conv_id string, canonical_seq long, message_uid string, sender string, occurred_at_epoch_s long, text string"
    df = spark.createDataFrame(rows, schema)
    late = spark.createDataFrame([("p", 0, "late", "ann", 5, "never seen")], schema)
    end = spark.createDataFrame([(None, 0, "end", None, 10**6, None)], schema)
    wave = F.floor((F.col("occurred_at_epoch_s") + F.crc32(F.col("message_uid").cast("binary")) % 7000) / 15000)
    parts = [df.filter(wave == i) for i in range(5)]
    parts[4] = parts[4].union(late)
    for i, part in enumerate([*parts, end]):
        one = str(tmp_path / f"part{i}")
        part.withColumn("ts", F.timestamp_seconds("occurred_at_epoch_s")).coalesce(1).write.parquet(one)
        file = next(f for f in os.listdir(one) if f.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(f"{one}/{file}", tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        dropped = []
        got = drain(streams.stream_chunks(stream, "8000 seconds", 3600, 30, 6), "append", lambda q: dropped.append(streams.late_counts(q)))
    assert dropped == [1]
    want = chunks.chunk_messages(df, 30, 6).select(*got.columns)
    assert want.count() > 20
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_items_equal_a_plain_fold(spark, sf):
    from threadloom.operators import canonical
    from threadloom.sources import views

    m = canonical.with_canonical_seq(views.events(spark, sf))
    got = {(r.conv_id, r.canonical_seq): (r.new_day, r.breaks, r.run) for r in timeline.timeline_items(m, "Asia/Shanghai").collect()}
    want, prev, run = {}, None, 0
    for r in m.orderBy("conv_id", "canonical_seq").collect():
        day = (r.occurred_at_epoch_s + 28800) // 86400
        if prev is None or prev[0] != r.conv_id:
            prev, run = (r.conv_id, None, None, 0), 0
        new = day != prev[1]
        broke = new or r.sender != prev[2] or r.occurred_at_epoch_s - prev[3] > 300
        run += broke
        want[r.conv_id, r.canonical_seq] = (new, broke, run)
        prev = (r.conv_id, day, r.sender, r.occurred_at_epoch_s)
    assert got == want
