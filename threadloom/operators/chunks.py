"""Search chunks of conversations, folded over blocks side by side.

A conversation's texts become units of bounded weight, and a chunk closes before the unit that would overfill it; the next one opens with
the last `overlap` tokens. As every chunk but the first opens with exactly that many, where chunks close depends on one number only: how full
the open chunk is. So each block of a conversation is a function from the fill at its start to the fill at its end, and the blocks'
functions, a few hundred numbers each, are composed in order; then every block cuts its own units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.functions import scalars
from threadloom.sources.shared import stored

#: Messages that one task numbers, and tokens of a block.
MESSAGES, TOKENS = 4096, 65_536
UNIT = "seq long, part int, uid string, sender string, name string, at long, piece string, n int"


def key_of(c: Column) -> Column:
    """A key that is never null: null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def message_units(messages: DataFrame, most: int, overlap: int, *keep: str, blanks: bool = False) -> DataFrame:
    """conv_id, the fields of UNIT, and keep: each message's trimmed text in pieces of at most most - overlap tokens; blank and null texts
    have none, or with blanks one row without a piece."""
    def given(c: str, t: str) -> Column:
        return (F.col(c) if c in messages.columns else F.lit(None)).cast(t)

    clean = scalars.trim_all(F.col("text"))
    rows = messages.select(
        "conv_id", F.col("canonical_seq").cast("long").alias("seq"), F.col("message_uid").cast("string").alias("uid"), given("sender", "string").alias("sender"),
        given("sender_name", "string").alias("name"), given("occurred_at_epoch_s", "long").alias("at"), F.nullif(clean, F.lit("")).alias("clean"), *keep,
    )
    # Only a text that is too heavy is taken apart character by character.
    pieces = F.when(scalars.search_tokens(F.col("clean")) <= most - overlap, F.array("clean")).otherwise(scalars.split_text(F.col("clean"), most - overlap))
    if blanks:
        cut = rows.select("*", F.posexplode_outer(F.when(F.col("clean").isNotNull(), pieces)).alias("part", "piece")).drop("clean")
    else:
        cut = rows.filter("clean IS NOT NULL").select("*", F.posexplode(pieces).alias("part", "piece")).drop("clean")
    return cut.withColumn("n", scalars.search_tokens(F.col("piece")).cast("int")).select("conv_id", *StructType.fromDDL(UNIT).names, *keep)


def placed_units(units: DataFrame) -> DataFrame:
    """units with key, total (tokens of the conversation), c (those before the unit) and block (c in TOKENS); sums go over runs of messages first."""
    run = F.floor(F.coalesce("seq", F.lit(-1)) / MESSAGES)
    rows = units.select(key_of(F.col("conv_id")).alias("key"), run.alias("run"), "*")
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("key", "run").agg(F.sum("n").alias("sum")).select("key", "run", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.sum("sum").over(Window.partitionBy("key")).alias("total"))
    inner = Window.partitionBy("key", "run").orderBy("seq", "uid", "part").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("own", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, ["key", "run"]).withColumn("c", F.col("base") + F.col("own"))
    return at.withColumn("block", F.floor(F.col("c") / TOKENS)).drop("run", "base", "own")


def chain(n: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For units of n tokens: where the chunk that opens before each one closes, the tokens that come before each, and their running sum."""
    upto = np.cumsum(n)
    before = upto - n
    return np.searchsorted(upto, before + room, side="right"), before, upto


def transfer(n: np.ndarray, room: int, fills: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fill of the open chunk at a block's start: its fill at the end, and how many chunks close within."""
    closes, before, upto = chain(n, room)
    fill, closed = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for q in range(len(n) - 1, -1, -1):
        r = closes[q]
        fill[q], closed[q] = (upto[-1] - before[q], 1) if r == len(n) else (fill[r], closed[r] + 1)
    first = np.searchsorted(upto, room - fills, side="right")
    inside = np.minimum(first, len(n) - 1)
    ends = first == len(n)
    return np.where(ends, fills + upto[-1], fill[inside]), np.where(ends, 0, closed[inside])


def block_starts(placed: DataFrame, most: int, overlap: int) -> DataFrame:
    """key, block, fill, index at the start of every block but a conversation's first."""
    room = most - overlap
    last = placed.groupBy("key").agg(F.max("block").alias("last")).filter("last > 0")
    inner = placed.join(last, "key").filter(F.col("block") < F.col("last")).select("key", "block", "c", "n")

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("c")
        key, block = t.column("key")[0].as_py(), t.column("block")[0].as_py()
        # A conversation's first chunk has the room of the overlap that it does not open with.
        fills = np.arange(room + 1) if block else np.array([-overlap])
        fill, closed = transfer(t.column("n").to_numpy(), room, fills)
        return pa.table({"key": [key], "block": [block], "fill": pa.array([fill.astype(np.int32)], pa.list_(pa.int32())), "closed": pa.array([closed.astype(np.int32)], pa.list_(pa.int32()))})

    functions = inner.groupBy("key", "block").applyInArrow(one, "key string, block long, fill array<int>, closed array<int>")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fill, index = None, 0, 0
        for b in batches:
            out = []
            for k, block, fills, closed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if k != key:
                    key, fill, index = k, 0, 0
                at = fill if block else 0
                fill, index = fills[at].as_py(), index + closed[at].as_py()
                out.append((k, block + 1, fill, index))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int32())], names=["key", "block", "fill", "index"])

    ordered = functions.repartition("key").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(compose, "key string, block long, fill int, index int")


def deal_block(table: pa.Table, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one block (sorted by c; halo rows of the block before come first) that go to chunks: row numbers, chunk numbers, and how many tokens of the row's end to keep (0: all)."""
    room = most - overlap
    c, n, halo = table.column("c").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("halo").to_numpy()
    start = int(halo.sum())
    if start == len(n):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    fill, index = table.column("fill")[start].as_py(), table.column("index")[start].as_py()
    own = n[start:]
    closes, _, upto = chain(own, room)
    opens, q = [], int(np.searchsorted(upto, room - fill, side="right"))
    while q < len(own):
        opens.append(q)
        q = int(closes[q])
    number = np.full(len(own), index, dtype=np.int64)
    number[opens] = np.arange(index + 1, index + 1 + len(opens))
    number = np.maximum.accumulate(number)
    rows, numbers, keeps = [np.arange(start, len(n))], [number], [np.zeros(len(own), dtype=np.int64)]
    ends = c + n
    for i, q in enumerate(opens):
        edge = c[start + q] - overlap
        tail = np.arange(int(np.searchsorted(ends, edge, side="right")), start + q)
        keep = np.where(c[tail] < edge, ends[tail] - edge, 0)
        rows.append(tail)
        numbers.append(np.full(len(tail), index + 1 + i))
        keeps.append(keep)
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(keeps)


def ending(piece: Column, keep: Column) -> Column:
    """The shortest end of a piece that weighs keep tokens: of light characters, that many quarters of which the last three round up; others are weighed one by one."""
    tail = F.substring(piece, -4 * keep, 4 * keep)
    points = F.reverse(F.regexp_extract_all(tail, F.lit("(?s)."), F.lit(0)))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("k"))
    more = lambda s, p: F.struct((s["w"] + scalars.point_weight(p)).alias("w"), (s["k"] + 1).alias("k"))
    each = F.aggregate(points, zero, lambda s, p: F.when(F.ceil(s["w"]) < keep, more(s, p)).otherwise(s), lambda s: s["k"])
    size = F.when(scalars.may_be_heavy(tail), each).otherwise(F.least(F.length(tail), 4 * keep - 3))
    return scalars.let(size, lambda k: F.substring(piece, -k, k))


def chunk_columns(folded: DataFrame) -> DataFrame:
    """Chunks from conv_id, index and units, an ordered array of UNIT with keep.

    conv_id, index, chunk_id, first_uid, last_uid, first_sequence, last_sequence, start_time, end_time, sender_ids, token_count, text, ngrams.
    """
    cut = lambda u: F.when(u["keep"] > 0, ending(u["piece"], u["keep"])).otherwise(u["piece"])
    who = lambda u: F.coalesce(F.nullif(u["name"], F.lit("")), u["sender"], F.lit(""))
    one, end = lambda k: F.col("units")[0][k], lambda k: F.element_at("units", -1)[k]
    text = F.array_join(F.transform("units", lambda u: F.concat(who(u), F.lit(": "), cut(u))), "\n")
    senders = F.array_distinct(F.filter(F.transform("units", lambda u: u["sender"]), lambda s: s.isNotNull() & (s != "")))
    tokens = F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + F.when(u["keep"] > 0, u["keep"]).otherwise(u["n"]))
    rows = folded.select(
        "conv_id", "index", one("uid").alias("first_uid"), end("uid").alias("last_uid"), one("seq").alias("first_sequence"), end("seq").alias("last_sequence"),
        one("at").alias("start_time"), end("at").alias("end_time"), senders.alias("sender_ids"), tokens.alias("token_count"), text.alias("text"),
    )
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.sha2(F.concat_ws("\n", plain("conv_id"), plain("first_uid"), plain("last_uid"), plain("index"), "text"), 256)
    return rows.withColumns({"chunk_id": name, "ngrams": F.array_join(scalars.ngrams(F.col("text")), " ")})


def chunk_messages(messages: DataFrame, most: int = 800, overlap: int = 80) -> DataFrame:
    """Search chunks of conversations: see chunk_columns(). messages: conv_id, canonical_seq, message_uid, text; sender, sender_name
    and occurred_at_epoch_s where there are any.

    A chunk closes before the unit that would take it over `most` tokens, or when it is exactly full, so a least size below `most` would change
    nothing. The next one opens with the last `overlap` tokens, the first unit of them cut to what is left. Blank and null texts have no
    part; messages without a conversation are one conversation of their own; an empty table has no chunks. No task holds more than a block of a conversation.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below most")
    every = stored(placed_units(message_units(messages, most, overlap)))
    # A conversation that one chunk holds has nothing to fold.
    placed = every.filter(F.col("total") > most).drop("total")
    starts = stored(block_starts(placed, most, overlap))
    # The last `overlap` tokens of a block are wanted by the next one too.
    sizes = placed.groupBy("key", "block").agg(F.max(F.col("c") + F.col("n")).alias("end"))
    near = (F.col("c") + F.col("n")) > F.col("end") - overlap
    both = placed.join(sizes, ["key", "block"]).select("*", F.explode(F.when(near, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("halo"))
    both = both.withColumn("block", F.col("block") + F.col("halo").cast("int")).drop("end")
    rows = both.join(starts, ["key", "block"], "left").withColumns({"fill": F.coalesce("fill", F.lit(-overlap)), "index": F.coalesce("index", F.lit(0))})
    kept = ["conv_id", "c", *StructType.fromDDL(UNIT).names]
    schema = StructType([*(f for f in rows.schema if f.name in kept), *StructType.fromDDL("key string, index int, keep int")])
    names = schema.names

    def deal(table: pa.Table) -> pa.Table:
        t = table.sort_by([("halo", "descending"), ("c", "ascending")])
        at, number, keep = deal_block(t, most, overlap)
        got = t.take(pa.array(at)).drop_columns(["index"])
        return got.append_column("index", pa.array(number, pa.int32())).append_column("keep", pa.array(keep, pa.int32())).select(names)

    whole = every.filter(F.col("total") <= most).withColumns({"index": F.lit(0), "keep": F.lit(0)}).select(names)
    dealt = rows.groupBy("key", "block").applyInArrow(deal, schema).unionByName(whole)
    fields = [*StructType.fromDDL(UNIT).names, "keep"]
    gathered = dealt.groupBy("key", "index").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("c", *fields))).alias("units"))
    return chunk_columns(gathered.select("conv_id", "index", F.transform("units", lambda u: F.struct(*[u[f].alias(f) for f in fields])).alias("units")))
