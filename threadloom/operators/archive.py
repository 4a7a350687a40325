"""The append-only archive: which candidates are copied where, settled in rounds of claims, and what is wrong with earlier copies.

Read one after the other, a candidate takes its target, or the target with eight digits of its hash where other content has it, or
nothing. Here every round settles all candidates that no undecided earlier one can get in the way of, so rounds are as many as
the longest chain of candidates that wait for each other, not as many as candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.sources.shared import stored


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")


def _keyed(df: DataFrame) -> DataFrame:
    """key, sha256, path: one row per path, letter case aside."""
    rows = df.select(F.lower(normal_path(F.col("archive_path"))).alias("key"), "sha256", F.col("archive_path").alias("path"))
    last = F.max_by(F.struct("sha256", "path"), F.struct("path", "sha256")).alias("x")
    return rows.groupBy("key").agg(last).select("key", "x.sha256", "x.path")


def archive_issues(previous: DataFrame, existing: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """kind, archive_path, expected_sha256, actual_sha256: earlier copies that are missing or changed, and candidates whose target and
    second target are both taken (of plan, see plan_archive())."""
    have = _keyed(existing).select("key", F.col("sha256").alias("actual_sha256"))
    before = previous.select(F.lower(normal_path(F.col("archive_path"))).alias("key"), "archive_path", F.col("sha256").alias("expected_sha256")).join(have, "key", "left")
    kind = F.when(F.col("actual_sha256").isNull(), "missing-previous-copy").when(F.col("actual_sha256") != F.col("expected_sha256"), "changed-previous-copy")
    out = before.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "archive_path", "expected_sha256", "actual_sha256")
    if plan is None:
        return out
    return out.unionByName(plan.filter("action = 'conflict'").select(F.lit("target-conflict").alias("kind"), "archive_path", F.col("sha256").alias("expected_sha256"), "actual_sha256"))


def plan_archive(previous: DataFrame, cands: DataFrame, existing: DataFrame, again: bool = True) -> DataFrame:
    """cands (file_id, sha256, target), previous (sha256, archive_path), existing (archive_path, sha256) ->
    file_id, sha256, action, archive_path, actual_sha256; one row per candidate.

    In order of file_id (equal rows in any order): content that the archive records is reused (`reuse`, with its path); else the target is
    taken if it is vacant (`copy`) or holds this very content unrecorded (`reuse_copy`). Paths of the previous archive are reserved, present or not,
    paths are compared without regard to case, and a taken one gets a suffix of the hash; if that is taken too, the candidate is a `conflict` with
    what is there, and a later one of its content may still be copied; without again, a content is planned once, and later ones are `reuse` with
    the path of the conflict. Nothing is ever copied onto other content.
    Candidates without a hash or a target cannot be archived: `skip`.
    """
    was = previous.select("sha256", normal_path(F.col("archive_path")).alias("path"), F.col("archive_path").alias("as_written"))
    kept = _keyed(previous).select("key", F.col("sha256").alias("reserved"))
    have = _keyed(existing).select("key", F.col("sha256").alias("there"))
    # What stands at a path: the hash that is there, and whether the archive records the path.
    taken = stored(kept.join(have, "key", "full").select("key", F.coalesce("there", "reserved").alias("there"), F.col("reserved").isNotNull().alias("recorded")))
    known = stored(was.groupBy("sha256").agg(F.min("as_written").alias("known")))
    rows = cands.select("file_id", "sha256", normal_path(F.col("target")).alias("first")).withColumn("second", rules.append_hash8(F.col("first"), F.col("sha256")))
    rows = stored(rows.withColumns({"k1": F.lower("first"), "k2": F.lower("second"), "rid": F.monotonically_increasing_id()}))
    out = [rows.filter("sha256 IS NULL OR first IS NULL").select("file_id", "sha256", F.lit("skip").alias("action"), F.lit(None).cast("string").alias("archive_path"), F.lit(None).cast("string").alias("actual_sha256"))]
    left = rows.filter("sha256 IS NOT NULL AND first IS NOT NULL").withColumn("order", F.struct("file_id", "rid"))
    # Struct keys hide known partitionings, so AQE may split a content or a path that many candidates share.
    key = lambda c, name: F.struct(F.col(c).alias("v")).alias(name)

    while True:
        t1 = taken.select(key("key", "j1"), F.col("there").alias("there1"), F.col("recorded").alias("recorded1"))
        t2 = taken.select(key("key", "j2"), F.col("there").alias("there2"), F.col("recorded").alias("recorded2"))
        h = known.select(key("sha256", "j0"), "known")
        seen = left.select("*", key("sha256", "j0"), key("k1", "j1"), key("k2", "j2")).join(h, "j0", "left").join(t1, "j1", "left").join(t2, "j2", "left")
        clash = lambda n: F.col(f"there{n}").isNotNull() & (F.col(f"recorded{n}") | (F.col(f"there{n}") != F.col("sha256")))
        seen = stored(seen.withColumns({"clash1": clash(1), "clash2": clash(2)}))
        reused = seen.filter("known IS NOT NULL")
        open_ = seen.filter("known IS NULL")
        # The paths that a candidate may still take: its target while that is free for it, and its second target.
        may = F.explode(F.when(F.col("clash1"), F.array("k2")).otherwise(F.array_distinct(F.array("k1", "k2"))))
        firsts = open_.select("order", may.alias("k")).groupBy("k").agg(F.min("order").alias("first_path"))
        of_hash = open_.groupBy("sha256").agg(F.min("order").alias("first_hash"))
        want = open_.withColumn("want", F.when(F.col("clash1"), F.col("k2")).otherwise(F.col("k1")))
        turn = want.select("*", key("want", "jw")).join(firsts.select(key("k", "jw"), "first_path"), "jw").join(of_hash.select(key("sha256", "j0"), "first_hash"), "j0")
        turn = stored(turn.withColumn("ready", (F.col("order") == F.col("first_path")) & (F.col("order") == F.col("first_hash"))))
        ready = turn.filter("ready")
        there = F.when(F.col("clash1"), F.col("there2")).otherwise(F.col("there1"))
        action = F.when(F.col("clash1") & F.col("clash2"), "conflict").when(there.isNotNull(), "reuse_copy").otherwise("copy")
        path = F.when(F.col("clash1"), F.col("second")).otherwise(F.col("first"))
        done = ready.select("file_id", "sha256", action.alias("action"), path.alias("archive_path"), F.when(action == "conflict", there).alias("actual_sha256"), "want")
        out += [reused.select("file_id", "sha256", F.lit("reuse").alias("action"), F.col("known").alias("archive_path"), F.lit(None).cast("string").alias("actual_sha256")), done.drop("want")]
        new = done.filter("action <> 'conflict'")
        rest = turn.filter("NOT ready").select("file_id", "sha256", "first", "second", "k1", "k2", "rid", "order")
        if rest.isEmpty():
            break
        settled = new.select(F.col("want").alias("key"), F.col("sha256").alias("there"), F.lit(True).alias("recorded"))
        taken = stored(taken.join(settled.select("key"), "key", "left_anti").unionByName(settled))
        known = stored(known.unionByName((new if again else done).select("sha256", F.col("archive_path").alias("known"))))
        left = rest
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
