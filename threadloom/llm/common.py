"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import math
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, the warehouse serves if it is in a store of its own or all executors run in this process,
    as in tests; on a cluster a folder of one machine is refused.
    """
    context = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.getCheckpointDir().isDefined():
        base = context.getCheckpointDir().get()
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = warehouse.startswith(("/", "file:")) or "://" not in warehouse
    if local and not context.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_shared"


def materialize(df: DataFrame) -> DataFrame:
    """stored() for tables that live as long as the application."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back: the table and its path.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. The
    files go when the application ends. A re-read table has no known
    partitioning, so later joins shuffle both sides and AQE can split a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path), path


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; tasks of one executor reuse it."""
    holder = sys.modules.setdefault("__threadloom_worker__", types.ModuleType("__threadloom_worker__"))
    return holder.__dict__.setdefault(name, {})


def drop_worker_caches(but: str | None = None) -> None:
    """Free the caches that functions of another kind left in this Python worker."""
    holder = sys.modules.get("__threadloom_worker__")
    for name in [n for n, c in vars(holder).items() if isinstance(c, dict) and n != but] if holder else []:
        del holder.__dict__[name]


def release_memory() -> None:
    """Give memory that this Python worker has freed back to the system; workers of other stages share it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows that a Python function sees at once; long texts make Arrow batches of 10,000 rows too large to unpack whole.
SLICE = 500


def map_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cache: str | None = None) -> DataFrame:
    """Columns computed from texts, a slice of rows at a time, by one function per task.

    make() returns f(list of str or None) -> {column: list or array}; schema is the DDL of these
    columns. cache: the worker_cache() that f uses; others are freed. Columns in keep pass through untouched. text is a column, or `column.field` of a struct in keep.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    out = StructType([f for k in keep for f in df.schema if f.name == k] + list(new))
    types_ = list(to_arrow_schema(new))
    column, _, field = text.partition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_caches(cache)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                texts = b.column(keep.index(column)).field(field) if field else b.column(len(keep))
                got = f(texts.to_pylist())
                cols = [b.column(i) for i in range(len(keep))] + [pa.array(got[t.name], type=t.type) for t in types_]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(t.name for t in types_)])
        del f
        release_memory()

    return df.select(*keep, *([] if field else [text])).mapInArrow(run, out)


def text_key(c: Column) -> Column:
    """A grouping key that is never null: equal for equal values, and one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def hash_bucket(order: Column, n: int) -> Column:
    """Bucket 0 to b-1 of a lower-case hex digest, rising with it; b = ceil(sqrt(n)), so that
    buckets and the rows in each grow alike, with the square root of the table."""
    b = max(1, math.ceil(math.sqrt(n)))
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.lit(b) / F.lit(2**32)).cast("long")


def running_offsets(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str, per_group: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of value within group, in (bucket, order).

    Two levels keep a hot group parallel: sums per (group, bucket) are added up
    first, then each bucket counts on its own. group and bucket are never null.
    per_group: columns to attach per group, joined to the small sums rather than to the rows.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    if per_group is not None:
        base = base.join(per_group, group)
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, [group, bucket])
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("__base")
    )
