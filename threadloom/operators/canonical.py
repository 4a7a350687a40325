"""Shards to canonical messages: senders, order, duplicates, rollups, closed inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.sources.shared import stored

ORDER = ("occurred_at_epoch_s", "source_sort_seq")


class ConflictError(ValueError):
    """Rows that claim one identity and differ in meaning."""


class ClosureError(ValueError):
    """Rows of a shard are neither parsed, nor copies, nor excluded, or more than one of these."""


def canonical_order() -> list[Column]:
    """Time, sort key, regular before biz, shard, local id: a total order within a conversation's source rows."""
    return [F.col("occurred_at_epoch_s"), F.col("source_sort_seq"), F.when(F.col("source_adapter") == "regular", 0).otherwise(1), F.col("source_db"), F.col("local_id")]


def before_bucket(df: DataFrame, bucket: str, value: Column, out: str) -> DataFrame:
    """conv_id, bucket, out: the sum of value over a conversation's earlier buckets. One row per bucket, summed on every task before it moves."""
    sums = df.groupBy("conv_id", bucket).agg(F.sum(value).alias("__v"))
    w = Window.partitionBy("conv_id").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv_id", bucket, F.coalesce(F.sum("__v").over(w), F.lit(0)).alias(out))


def never_null(c: Column) -> Column:
    """A key that joins null to null: rows without a conversation are one conversation of their own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def with_canonical_seq(df: DataFrame, bucket_s: int = 86_400) -> DataFrame:
    """Adds canonical_seq, from 0 per conversation; rows without a conversation or a time are numbered too.

    Rows are numbered within (conversation, day) and start where the days before end, so a conversation
    that holds much of the archive is spread over as many tasks as it has days.
    """
    d = df.withColumns({"__day": F.coalesce(F.floor(F.col("occurred_at_epoch_s") / bucket_s), F.lit(-(2**40))), "__key": never_null(F.col("conv_id"))})
    base = before_bucket(d, "__day", F.lit(1), "__base").withColumn("__key", never_null(F.col("conv_id"))).drop("conv_id")
    n = F.row_number().over(Window.partitionBy("__key", "__day").orderBy(*canonical_order()))
    numbered = d.join(base, ["__key", "__day"], "left").withColumn("canonical_seq", (F.coalesce("__base", F.lit(0)) + n - 1).cast("long"))
    return numbered.select(*df.columns, "canonical_seq")


def join_senders(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds mapped_sender. Ids are those of one shard, so the shard is part of the key; Spark broadcasts the map when it is small."""
    m = ids.select("source_db", F.col("rowid").alias("real_sender_id"), F.col("user_name").alias("mapped_sender"))
    return raw.join(m, ["source_db", "real_sender_id"], "left")


def join_contacts(convs: DataFrame, contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    c = contacts.select("username", F.col("display").alias("contact_display"))
    return convs.join(c, "username", "left").join(sessions.select("username", "summary", "last_time"), "username", "left").withColumn("display", F.coalesce("contact_display", "username")).drop("contact_display")


def join_tables(raw: DataFrame, usernames: DataFrame) -> DataFrame:
    """Adds the username whose md5 names the row's table; null where no known name fits."""
    return raw.join(usernames.select("username", scalars.msg_table(F.col("username")).alias("source_table")), "source_table", "left")


def marked_copies(df: DataFrame, meaning: tuple[str, ...]) -> DataFrame:
    """df, written out once, with __first: whether a row is the first in canonical order of those of one conversation with one server id.

    Raises ConflictError if copies differ in meaning. Rows without a server id have no copies.
    """
    sid = scalars.clean_server_id(F.col("server_id"))
    key = F.when(sid.isNotNull(), F.concat(F.lit("s:"), sid)).otherwise(F.concat_ws(":", F.lit("l"), "source_db", F.col("local_id").cast("string")))
    w = Window.partitionBy("conv_id", "__key")
    fp = scalars.fingerprint(*[F.col(c) for c in meaning])
    alike = F.min("__fp").over(w) == F.max("__fp").over(w)
    seen = df.withColumns({"__key": key, "__fp": fp}).withColumns({"__first": F.row_number().over(w.orderBy(*canonical_order())) == 1, "__alike": alike})
    seen = stored(seen.drop("__fp"))
    clash = seen.filter("NOT __alike").select("conv_id", "__key").distinct().limit(3).collect()
    if clash:
        raise ConflictError(f"copies differ in meaning: {[tuple(r) for r in clash]}")
    return seen.drop("__key", "__alike")


def dedup_messages(df: DataFrame, meaning: tuple[str, ...] = ("sender", "raw_type", "text")) -> DataFrame:
    """Of rows of one conversation with one server id, the first in canonical order; rows without an id all stay. See marked_copies()."""
    return marked_copies(df, meaning).filter("__first").drop("__first")


def union_shards(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_usernames(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [p.select("username") for p in parts]).filter(F.trim("username") != "").distinct()


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """conv_id, msg_count, text_count (type 1 with text), first_time, last_time."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("msg_count"), F.count_if((F.col("type") == 1) & (F.length("text") > 0)).alias("text_count"), F.min("occurred_at_epoch_s").alias("first_time"), F.max("occurred_at_epoch_s").alias("last_time"),
    )


def close_inventory(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """units (source_db, discovered) and outcomes (source_db, outcome in parsed, deduplicated, ...) -> counts that add up:
    what is neither parsed nor a duplicate is excluded, with a reason."""
    o = outcomes.groupBy("source_db").agg(F.count_if(F.col("outcome") == "parsed").alias("parsed"), F.count_if(F.col("outcome") == "deduplicated").alias("deduplicated"))
    j = units.join(o, "source_db", "left").fillna(0, ["parsed", "deduplicated"])
    excluded = F.col("discovered") - F.col("parsed") - F.col("deduplicated")
    return j.select("source_db", "discovered", "parsed", "deduplicated", excluded.alias("excluded"), F.when(excluded > 0, "not_parsed").otherwise("").alias("exclusion_reason"))


def run_receipt_row(inventory: DataFrame, messages: DataFrame) -> DataFrame:
    t = inventory.agg(*[F.sum(c).alias(c) for c in ("discovered", "parsed", "deduplicated", "excluded")])
    m = messages.agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("conversations"))
    return t.crossJoin(m)  # one row each


def people(messages: DataFrame, owner: str) -> DataFrame:
    o = F.lit(owner)
    return messages.filter(F.col("sender").isNotNull() & (F.trim("sender") != "")).select("sender").distinct().select(scalars.person_id(o, F.col("sender")).alias("person_id"), o.alias("owner"), F.col("sender").alias("username"))


def build_canonical(raw: DataFrame, ids: DataFrame, owner: str, zone: str = "UTC") -> dict[str, DataFrame]:
    """Raw shard rows to messages, people, conversations, inventory and a receipt.

    A conversation is a group by its name (`...@chatroom`); in private ones is_own, where raw has it, tells the owner's messages from the peer's, and
    senders that neither the id map nor that settles stay unresolved with a reason. Rows that raw gives an exclusion_reason
    are left out and counted by shard. Messages are made once and stored; ClosureError if parsed, deduplicated (counted
    on their own) and excluded rows do not add up to those discovered in every shard.
    """
    reason = F.col("exclusion_reason") if "exclusion_reason" in raw.columns else F.lit(None).cast("string")
    own = F.col("is_own").cast("boolean") if "is_own" in raw.columns else F.lit(None).cast("boolean")
    units = raw.groupBy("source_db").agg(F.count("*").alias("discovered"), F.count(reason).alias("excluded"))
    typed = join_senders(raw.filter(reason.isNull()), ids).withColumn("type", scalars.norm_type(F.col("raw_type")))
    who = scalars.resolve_sender(F.coalesce(F.col("conv_id").endswith("@chatroom"), F.lit(False)), F.col("mapped_sender"), F.col("sender"), F.lit(owner), F.col("conv_id"), own)
    named = typed.withColumn("who", who).drop("sender", "mapped_sender").select("*", "who.sender", "who.sender_source", "who.sender_audit").drop("who")
    marked = marked_copies(named, ("raw_type", "text"))
    copies = marked.filter("NOT __first").groupBy("source_db").agg(F.count("*").alias("deduplicated"))
    first = marked.filter("__first").drop("__first")
    kept = stored(with_canonical_seq(first).withColumn("archive_day", scalars.archive_day(F.col("occurred_at_epoch_s"), zone)))
    parsed = kept.groupBy("source_db").agg(F.count("*").alias("parsed"))
    inv = units.join(parsed, "source_db", "left").join(copies, "source_db", "left").fillna(0, ["parsed", "deduplicated"])
    inv = stored(inv.select("source_db", "discovered", "parsed", "deduplicated", "excluded"))
    open_ = inv.filter("discovered <> parsed + deduplicated + excluded").limit(3).collect()
    if open_:
        raise ClosureError(f"rows of these shards do not add up: {[r['source_db'] for r in open_]}")
    return {"messages": kept, "people": people(kept, owner), "conversations": conversation_rollup(kept), "inventory": inv, "receipt": run_receipt_row(inv, kept)}


def select_snapshots(keys: DataFrame) -> DataFrame:
    """(owner, snapshot, updated_at, key) -> snapshots that a newer one of the same owner contains whole: owner, snapshot, covered_by.

    Shared keys are counted per pair by a join on the key, so pairs without common keys never meet; keys are
    grouped into sets of snapshots first, so a key that many snapshots hold costs the pairs of snapshots only once per set.
    """
    k = keys.select("owner", "snapshot", "updated_at", "key").distinct()
    size = k.groupBy("owner", "snapshot", "updated_at").agg(F.count("*").alias("n"))
    sets = k.groupBy("owner", "key").agg(F.array_sort(F.collect_set(F.struct("updated_at", "snapshot"))).alias("s")).groupBy("owner", "s").agg(F.count("*").alias("shared"))
    a = sets.select("owner", "shared", "s", F.explode("s").alias("old")).select("owner", "shared", "old", F.explode("s").alias("new")).filter("old.updated_at < new.updated_at")
    pair = a.groupBy("owner", "old", "new").agg(F.sum("shared").alias("shared"))
    full = pair.join(size, (pair.owner == size.owner) & (F.col("old.snapshot") == size.snapshot) & (F.col("shared") == size.n)).select(pair.owner, F.col("old.snapshot").alias("snapshot"), F.col("new.snapshot").alias("by"))
    return full.groupBy("owner", "snapshot").agg(F.min("by").alias("covered_by"))


def text_rows(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("type") == 1) & (F.length("text") > 0))


def min_text(messages: DataFrame, least: int = 20) -> DataFrame:
    """conv_id, texts: conversations with at least that many texts."""
    return text_rows(messages).groupBy("conv_id").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row, fingerprint: equal for equal multisets of rows in any order and partitioning.

    Each row's sha256 is cut into four numbers; their sums and the row count are hashed. Sums are partial on every task, so nothing is sorted or gathered.
    """
    h = df.select(scalars.fingerprint(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    part = lambda i: F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = h.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("fingerprint"))


def reconcile_source(output: DataFrame, source: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Row by row: source_db, local_id, code for every difference. `output-row-missing`, `source-row-missing`, `source-row-ambiguous`, `source-<field>-mismatch`."""
    key = ["source_db", "local_id"]
    s = source.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct(*fields)).alias("s"))
    o = output.select(*key, F.struct(*fields).alias("o"))
    j = o.join(s, key, "full_outer")
    gone = F.when(F.col("o").isNull(), F.lit("output-row-missing")), F.when(F.col("s").isNull(), F.lit("source-row-missing")), F.when(F.col("copies") > 1, F.lit("source-row-ambiguous"))
    both = F.col("o").isNotNull() & F.col("s").isNotNull()
    diff = [F.when(both & ~F.col(f"o.{f}").eqNullSafe(F.col(f"s.{f}")), F.lit(f"source-{f.replace('_', '-')}-mismatch")) for f in fields]
    return j.select(*key, F.explode(F.array_compact(F.array(*gone, *diff))).alias("code"))


def orphans(messages: DataFrame, convs: DataFrame) -> DataFrame:
    return messages.join(convs.select("conv_id"), "conv_id", "left_anti")


def id_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: ids that only one side has."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))
