"""Streams over the events table, run until the input is used up; each must equal its batch twin."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from threadloom.plans.folds import chunk_sql
from threadloom.plans.registry import EV, query
from threadloom.sources.shared import new_path
from threadloom.streaming import streams


def source(spark, sf):
    """The events file as a stream, as messages."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.col("user_id").cast("string").alias("conv_id"), F.concat(F.lit("m"), (F.col("event_id") - F.col("event_id") % 10 % 2).cast("string")).alias("message_uid"), F.col("event_id").alias("canonical_seq"), F.col("event_type").alias("sender"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"))


def drain(df, mode, then=None):
    """The stream's result as a table in the shared folder. Complete mode keeps the last batch, append mode all of them. then: called with the ended query."""
    spark = df.sparkSession
    path = new_path(spark, "stream")
    write = "overwrite" if mode == "complete" else "append"
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, _: b.write.mode(write).parquet(f"{path}/rows")).start()
    q.awaitTermination()
    if then:
        then(q)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@contextmanager
def rocksdb(spark):
    """Lists, timers and values of one state need RocksDB as their store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


@query("r2_14_1_stream_dedup", f"WITH {EV} SELECT DISTINCT 'm' || (local_id - local_id % 10 % 2) AS message_uid FROM ev")
def dedup(spark, sf):
    return drain(streams.stream_dedup(source(spark, sf), "60 days").select("message_uid"), "append")


@query("r2_14_2_stream_days", f"WITH {EV} SELECT conv_id, strftime(make_timestamp((t + 28800) * 1000000), '%Y-%m-%d') AS day, count(*) AS messages FROM ev GROUP BY ALL")
def days(spark, sf):
    return drain(streams.stream_days(source(spark, sf), "60 days", 8), "complete")


@query("r2_14_3_stream_sessions", f"WITH {EV}, e AS (SELECT user_id::VARCHAR AS conv_id, ts FROM events), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS brk FROM e), r AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT conv_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT AS \"end\", count(*) AS messages FROM r GROUP BY conv_id, run")
def sessions(spark, sf):
    return drain(streams.stream_sessions(source(spark, sf), "60 days", 7200), "complete")


@query("r2_14_4_stream_delta", f"WITH {EV}, c AS (SELECT conv_id, count(*) FILTER (length(text) > 0) AS n FROM ev GROUP BY conv_id) SELECT conv_id, n AS growth, n AS total FROM c WHERE n >= 8")
def delta(spark, sf):
    return drain(streams.stream_delta(source(spark, sf)), "append")


@query("r2_14_5_stream_chunks", chunk_sql(EV + ", tu AS (SELECT conv_id, local_id AS seq, sender, t AS clock, text FROM ev)", "'m' || ({seq} - {seq} % 10 % 2)", 200, 20))
def chunks(spark, sf):
    """The events file, and a row without a text a year later, whose time closes the last chunks."""
    e = source(spark, sf)
    end = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    beat = end.select(*[(F.col("ts") + F.expr("INTERVAL 366 DAYS") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in e.schema])
    path = new_path(spark, "beat")
    beat.write.parquet(path)
    both = e.union(spark.readStream.schema(beat.schema).parquet(path)).withColumn("occurred_at_epoch_s", F.unix_timestamp("ts"))
    with rocksdb(spark):
        got = drain(streams.stream_chunks(both, "60 days", 3600, 200, 20), "append")
    return got.withColumn("senders", F.array_join(F.array_sort("sender_ids"), ",")).drop("sender_ids")
