"""Bundles: manifests, their digest and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.digests import ordered_digest


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def bundle_manifest(files: DataFrame) -> DataFrame:
    """files + bundle_digest, the hash of all lines in path order."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    d = ordered_digest(files.withColumn("bundle", F.lit(0)), "bundle", ["path"], line, "bundle_digest")
    return files.crossJoin(F.broadcast(d.select("bundle_digest")))  # one row


def verify_bundle(want: DataFrame, have: DataFrame) -> DataFrame:
    """path, problem: missing, unexpected, size or digest."""
    j = want.select("path", F.col("size").alias("s"), F.col("sha256").alias("d")).join(have.select("path", "size", "sha256"), "path", "full_outer")
    p = F.when(F.col("size").isNull(), "missing").when(F.col("s").isNull(), "unexpected").when(F.col("s") != F.col("size"), "size").when(F.col("d") != F.col("sha256"), "digest")
    return j.select("path", p.alias("problem")).filter("problem IS NOT NULL")
