"""Timeline reads: scope, facets, pages, context."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators import canonical

PAGE, MOST = 120, 240


def sender_key(sender: Column, name: Column | None = None) -> Column:
    parts = [F.nullif(sender, F.lit(""))] + ([F.nullif(name, F.lit(""))] if name is not None else [])
    return F.coalesce(*parts, F.lit("?"))


def literal_match(q: str, *cols: Column) -> Column:
    """Any column holds q as it stands; no character of it is a wildcard."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
    return out


def timeline_scope(df: DataFrame, conv: str | None = None, sender: str | None = None, q: str | None = None) -> DataFrame:
    if conv is not None:
        df = df.filter(F.col("conv_id") == conv)
    if sender is not None:
        df = df.filter(sender_key(F.col("sender")) == sender)
    return df.filter(literal_match(q, F.col("text"), F.col("sender"))) if q else df


def participants(df: DataFrame, conv: str | None = None, q: str | None = None) -> DataFrame:
    """conv_id, sender_key, person_id, name, identity_source, messages, last_time; most messages first, then by name.

    A sender without an id goes by the name the message shows, then by `?`. person_id is given only where all messages
    of the key that have one agree. identity_source says what stands behind the key: person_id, sender, name_snapshot
    or unknown. df may lack sender_name and person_id.
    """
    scoped = timeline_scope(df, conv, None, q)
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    sender, shown = F.nullif(F.col("sender"), F.lit("")), F.nullif(have("sender_name"), F.lit(""))
    rows = scoped.select("conv_id", "occurred_at_epoch_s", sender.alias("s"), shown.alias("n"), have("person_id").alias("p"))
    keyed = rows.withColumn("sender_key", F.coalesce("s", "n", F.lit("?"))).groupBy("conv_id", "sender_key")
    got = keyed.agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.max("n").alias("n"), F.max("s").alias("s"),
        F.count("*").alias("messages"), F.max("occurred_at_epoch_s").alias("last_time"),
    )
    person = F.when(F.col("low") == F.col("high"), F.col("high"))
    source = F.when(person.isNotNull(), "person_id").when(F.col("s").isNotNull(), "sender").when(F.col("n").isNotNull(), "name_snapshot").otherwise("unknown")
    name = F.coalesce("n", "s", F.lit("未知人物")).alias("name")
    out = got.select("conv_id", "sender_key", person.alias("person_id"), name, source.alias("identity_source"), "messages", "last_time")
    return out.orderBy("conv_id", F.desc("messages"), "name", "sender_key")


def day_facet(df: DataFrame, zone: str) -> DataFrame:
    """conv_id, day, first_uid, first_seq, messages. Grouping needs one partial sum per (conversation, day) and task, where a window would move every row."""
    day = scalars.archive_day(F.col("occurred_at_epoch_s"), zone).alias("day")
    return df.groupBy("conv_id", day).agg(F.min_by("message_uid", "canonical_seq").alias("first_uid"), F.min("canonical_seq").alias("first_seq"), F.count("*").alias("messages"))


def _lagged() -> Window:
    return Window.partitionBy("conv_id").orderBy("canonical_seq")


def order_gaps(df: DataFrame) -> DataFrame:
    """Rows whose sequence is not one more than the row's before, or whose time is earlier."""
    w = _lagged()
    seq, time = F.lag("canonical_seq").over(w), F.lag("occurred_at_epoch_s").over(w)
    return df.select("conv_id", "canonical_seq", "occurred_at_epoch_s", seq.alias("seq0"), time.alias("time0")).filter((F.col("canonical_seq") != F.coalesce(F.col("seq0") + 1, F.lit(0))) | (F.col("occurred_at_epoch_s") < F.col("time0")))


def same_second_order(df: DataFrame) -> DataFrame:
    """Rows of one second that stand before a row which the source puts first."""
    w = Window.partitionBy("conv_id", "occurred_at_epoch_s").orderBy("canonical_seq")
    key = F.struct("source_sort_seq", F.when(F.col("source_adapter") == "regular", 0).otherwise(1).alias("a"), "source_db", "local_id")
    return df.withColumn("__k", key).withColumn("__p", F.lag("__k").over(w)).filter("__k < __p").drop("__k", "__p")


def timeline_items(df: DataFrame, zone: str, gap: int = 300) -> DataFrame:
    """conv_id, canonical_seq, new_day, breaks (new day, new sender or a gap of more than gap seconds), run (number of breaks so far).

    Every day breaks, so rows are compared within (conversation, day) only, and breaks of earlier days are added up per day.
    """
    d = df.withColumn("day", scalars.archive_day(F.col("occurred_at_epoch_s"), zone)).withColumn("who", sender_key(F.col("sender")))
    w = Window.partitionBy("conv_id", "day").orderBy("canonical_seq")
    new_day = F.row_number().over(w) == 1
    broke = new_day | (F.col("who") != F.lag("who").over(w)) | (F.col("occurred_at_epoch_s") - F.lag("occurred_at_epoch_s").over(w) > gap)
    d = d.select("conv_id", "day", "canonical_seq", new_day.alias("new_day"), broke.alias("breaks"))
    key = canonical.never_null
    base = canonical.before_bucket(d, "day", F.col("breaks").cast("long"), "base").withColumn("key", key(F.col("conv_id"))).drop("conv_id")
    d = d.withColumns({"key": key(F.col("conv_id")), "day": F.coalesce("day", F.lit(""))})
    inner = F.sum(F.col("breaks").cast("long")).over(Window.partitionBy("key", "day").orderBy("canonical_seq").rowsBetween(Window.unboundedPreceding, 0))
    return d.join(base.withColumn("day", F.coalesce("day", F.lit(""))), ["key", "day"], "left").select("conv_id", "canonical_seq", "new_day", "breaks", (F.coalesce("base", F.lit(0)) + inner).alias("run"))


@dataclass(frozen=True)
class Cursor:
    """A place in one run's timeline; a cursor of another run reads as None."""

    run_id: str
    seq: int
    uid: str

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps(asdict(self)).encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str, run_id: str) -> Cursor | None:
        try:
            got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            c = Cursor(str(got["run_id"]), int(got["seq"]), str(got["uid"]))
        except (ValueError, KeyError, TypeError):
            raise ValueError("the cursor cannot be read") from None
        return c if c.run_id == run_id else None


def _limit(n: int) -> int:
    return max(1, min(n, MOST))


def timeline_page(df: DataFrame, conv: str, before: int | None = None, after: int | None = None, limit: int = PAGE, **scope) -> DataFrame:
    """Messages next to a place, ascending; the newest ones without a place. Sorting stops at the limit on every task."""
    rows, n = timeline_scope(df, conv, **scope), _limit(limit)
    if after is not None:
        return rows.filter(F.col("canonical_seq") > after).orderBy("canonical_seq").limit(n)
    if before is not None:
        rows = rows.filter(F.col("canonical_seq") < before)
    return rows.orderBy(F.desc("canonical_seq")).limit(n).orderBy("canonical_seq")


def timeline_around(df: DataFrame, conv: str, seq: int, limit: int = PAGE, **scope) -> DataFrame:
    """Half of the page before the anchor, the anchor if it is in scope, the rest after it."""
    rows, n = timeline_scope(df, conv, **scope), _limit(limit)
    early = (n - 1) // 2
    a = rows.filter(F.col("canonical_seq") < seq).orderBy(F.desc("canonical_seq")).limit(early)
    b = rows.filter(F.col("canonical_seq") >= seq).orderBy("canonical_seq").limit(n - early)
    return a.unionByName(b).orderBy("canonical_seq")


def beyond(df: DataFrame, conv: str, lowest: int, highest: int) -> DataFrame:
    """One row: has_older, has_newer."""
    return df.filter(F.col("conv_id") == conv).agg(F.coalesce(F.min("canonical_seq") < lowest, F.lit(False)).alias("has_older"), F.coalesce(F.max("canonical_seq") > highest, F.lit(False)).alias("has_newer"))


def offset_page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page of a total order; an offset past the end is an error."""
    if offset and offset >= df.count():
        raise ValueError("the offset lies past the end")
    return df.orderBy(*order).offset(offset).limit(limit)


def day_page(days: DataFrame, conv: str, before: str | None, limit: int) -> DataFrame:
    """The latest days, limit + 1 of them: the last tells whether there are more."""
    d = days.filter(F.col("conv_id") == conv)
    if before is not None:
        d = d.filter(F.col("day") < before)
    return d.orderBy(F.desc("day")).limit(limit + 1)


def message_context(df: DataFrame, uid: str, radius: int) -> DataFrame:
    """A message with up to radius ones before and after it in its conversation."""
    r = max(0, min(radius, 20))
    at = df.filter(F.col("message_uid") == uid).select(F.col("conv_id").alias("c"), F.col("canonical_seq").alias("s")).limit(1)
    return df.join(F.broadcast(at), (F.col("conv_id") == F.col("c")) & F.col("canonical_seq").between(F.col("s") - r, F.col("s") + r)).drop("c", "s")  # at is one row


def pinned_first(convs: DataFrame, pins: list[str]) -> DataFrame:
    return convs.orderBy(F.col("conv_id").isin(*pins).desc(), F.desc("last_time"), "conv_id")


def merge_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both pages by message_uid; where both have one, b's row stays."""
    both = a.withColumn("__p", F.lit(0)).unionByName(b.withColumn("__p", F.lit(1)))
    w = Window.partitionBy("message_uid").orderBy(F.desc("__p"))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__p").orderBy("conv_id", "canonical_seq")


def chat_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("msg_count"), F.lit(0)).alias("messages"), F.coalesce(F.sum("text_count"), F.lit(0)).alias("texts"))


def take_recent(df: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """Per conversation the newest whole messages, up to the first that no longer fits."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("canonical_seq")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(tokens).over(w)).filter(F.col("__sum") <= budget).drop("__sum")


def sample_digest(df: DataFrame, head: int = 120, cap: int = 48_000) -> DataFrame:
    """Per conversation the first `head` rows and, of the others, the longest until the text so far reaches cap."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("canonical_seq"))
    d = df.withColumn("__r", first).withColumn("__len", F.length("text"))
    w = Window.partitionBy("conv_id").orderBy((F.col("__r") > head).cast("int"), F.when(F.col("__r") > head, -F.col("__len")).otherwise(F.col("__r")), "canonical_seq").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("__so", F.coalesce(F.sum("__len").over(w), F.lit(0))).filter((F.col("__r") <= head) | (F.col("__so") < cap)).drop("__r", "__len", "__so")


def nth_text(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("canonical_seq")
    return df.filter(F.length("text") > 0).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == n).drop("__n")


def transcripts(df: DataFrame, zone: str) -> DataFrame:
    """conv_id, transcript: a header line and one line per message in canonical order."""
    line = F.concat(F.lit("["), scalars.archive_ts(F.col("occurred_at_epoch_s"), zone), F.lit("] "), sender_key(F.col("sender")), F.lit(": "), F.coalesce("text", F.lit("")))
    g = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("canonical_seq", line.alias("l")))).alias("ls"))
    return g.select("conv_id", F.concat_ws("\n", F.concat(F.lit("# "), "conv_id"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("transcript"))


def write_transcripts(df: DataFrame, path: str, zone: str) -> None:
    """Transcript lines as text files, a folder per conversation; files and lines are in canonical order, and a long conversation spreads over several files."""
    line = F.concat(F.lit("["), scalars.archive_ts(F.col("occurred_at_epoch_s"), zone), F.lit("] "), sender_key(F.col("sender")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = df.repartitionByRange("conv_id", "canonical_seq").sortWithinPartitions("conv_id", "canonical_seq")
    rows.select("conv_id", line.alias("value")).write.partitionBy("conv_id").text(path)


def write_daily_export(df: DataFrame, path: str, zone: str) -> None:
    """Messages as JSON lines, a folder per conversation and day."""
    df.withColumn("archive_day", scalars.archive_day(F.col("occurred_at_epoch_s"), zone)).repartition("conv_id", "archive_day").sortWithinPartitions("conv_id", "canonical_seq").write.partitionBy("conv_id", "archive_day").json(path)


def conversation_index(convs: DataFrame, cut: int = 120) -> DataFrame:
    return convs.select("conv_id", "msg_count", "last_time", F.substring(F.coalesce("summary", F.lit("")), 1, cut).alias("summary")).orderBy(F.desc("last_time"), "conv_id")
