"""SHA-256 over many rows in order, without a row, an array or a task that holds them all.

SHA-256 reads its bytes one after the other, so a key's bytes pass through one task, but joined in chunks of bounded length that stream through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.shared import stored

#: Rows whose texts one array joins.
CHUNK = 1024


def ordered_digest(rows: DataFrame, key: str, order: list[str], text: Column, name: str, sep: str = "\n", place: Column | None = None) -> DataFrame:
    """key, name: the hash of the texts of each key's rows in order, joined by sep; null texts count as empty, a null key is a key.

    place: a number that rises with order within a key, where there is one (such as canonical_seq); else the rows are range-sorted once.
    """
    rows = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(text, F.lit("")).alias("text"), *([] if place is None else [place.cast("long").alias("at")]))
    by = [f"o{i}" for i in range(len(order))]
    if place is None:
        rows = stored(rows.repartitionByRange("key", *by).sortWithinPartitions("key", *by).withColumn("at", F.monotonically_increasing_id()))
    chunks = rows.groupBy("key", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", *by, "text"))).alias("x"))
    joined = chunks.select("key", "chunk", F.array_join(F.transform("x", lambda r: r["text"]), sep).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row(keys: list, digests: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests, pa.string())], names=["key", "digest"])

        kind = pa.null()
        for b in batches:
            kind = b.schema.field("key").type
            keys, digests = [], []
            for k, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                if digest is None or k != key:
                    if digest is not None:
                        keys.append(key)
                        digests.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(sep.encode())
                digest.update(text.as_buffer())
            yield row(keys, digests)
        if digest is not None:
            yield row([key], [digest.hexdigest()])

    kind = dict(joined.dtypes)["key"]
    ordered = joined.repartition("key").sortWithinPartitions("key", "chunk").select("key", "text")
    return ordered.mapInArrow(run, f"key {kind}, digest string").select(F.col("key").alias(key), F.col("digest").alias(name))
