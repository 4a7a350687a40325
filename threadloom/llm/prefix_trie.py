"""The trie of conversation prefixes, and what sharing them saves, by the Euler-tour technique.

Every node of the trie gives an arc that enters it and one that leaves it. The tour through all arcs is a linked list; list ranking gives
each arc its position, and running sums along the positions give every subtree its leaves and savings as a difference.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, stored

#: Turns of a conversation whose prefix keys one task computes, and conversations whose numbers are joined into one text at once.
BLOCK, CHUNK = 1000, 1024


def sorted_slices(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted over all partitions, written out, with the number of its partition as slice; a hot key covers several slices."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id()))


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), h1, h2 (two hashes of role and text), chars. Turns stand in order of turn, null first; ties by role,
    then by the md5 of the text. Null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.md5(text).alias("tie"), F.length(text).alias("chars"),
        F.xxhash64(F.lit(1), F.length(role), role, text).alias("h1"), F.xxhash64(text, F.lit(2), role).alias("h2"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    rows = sorted_slices(rows, F.col("conv_id"), *order)
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n")).select("conv_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order)) - 1
    return rows.withColumn("nth", nth).join(base, ["conv_id", "slice"]).select("conv_id", (F.col("base") + F.col("nth")).alias("i"), "h1", "h2", "chars")


def rebuild(turns: DataFrame, share: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their rebuilt turns (conv_id, pos from 0, h1, h2, chars).

    Conversation c opens with the first h turns of conversation c - c % share (all of them if it has fewer), h = crc32(c) % most,
    and goes on with its own turns after its first h.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    opens = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "n", opens.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared")))
    first = turns.filter(F.col("i") < most - 1).withColumnRenamed("conv_id", "base")
    head = convs.join(first, "base").filter(F.col("i") < F.col("h")).select("conv_id", F.col("i").alias("pos"), "h1", "h2", "chars")
    # A struct key hides the known partitioning, so AQE may split a hot conversation.
    own = turns.select(F.struct("conv_id").alias("k"), "i", "h1", "h2", "chars").join(convs.select(F.struct("conv_id").alias("k"), "h", "shared"), "k")
    tail = own.filter(F.col("i") >= F.col("h")).select("k.conv_id", (F.col("shared") + F.col("i") - F.col("h")).alias("pos"), "h1", "h2", "chars")
    return convs.select("conv_id"), head.union(tail)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, p1, p2, chars: the key of the prefix that ends with each turn, and of the one before it.

    A key is the exclusive or of hashes of (position, turn), 128 bits, so blocks of a long conversation are keyed side by side.
    """
    salted = turns.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), "chars", F.xxhash64("pos", "h1").alias("x1"), F.xxhash64("h2", "pos").alias("x2"))
    salted = materialize(salted)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    base = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")])
    inner = Window.partitionBy("conv_id", "block").orderBy("pos")
    keyed = salted.withColumns({"r1": F.bit_xor("x1").over(inner), "r2": F.bit_xor("x2").over(inner)}).join(base, ["conv_id", "block"])
    k1, k2 = F.col("b1").bitwiseXOR(F.col("r1")), F.col("b2").bitwiseXOR(F.col("r2"))
    return keyed.select("conv_id", (F.col("pos") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), "chars")


def build_trie(convs: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (nid, key, conv_id, depth, n_convs, chars, n_children, first, parent, parent_conv_id, next_sibling), numbers of nodes
    all but conv_id and parent_conv_id, and the node at which each conversation ends (nid, conv_id)."""
    key = F.struct("depth", "k1", "k2").alias("key")
    found = keyed.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").cast("long").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    nodes = materialize(found.select(*root.columns).union(root).withColumn("nid", F.monotonically_increasing_id()))
    below = nodes.filter("depth > 0").select("nid", "conv_id", F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("key"))
    above = nodes.select(key, F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = sorted_slices(below.join(above, "key").select("nid", "conv_id", "parent", "parent_conv_id"), F.col("parent"), F.col("conv_id"))
    # The next sibling stands in the same slice, or is the first child in the parent's next slice.
    heads = children.groupBy("parent", "slice").agg(F.min_by("nid", "conv_id").alias("head"))
    heads = heads.withColumn("later", F.lead("head").over(Window.partitionBy("parent").orderBy("slice"))).select("parent", "slice", "later")
    lead = F.lead("nid").over(Window.partitionBy("parent", "slice").orderBy("conv_id"))
    linked = children.withColumn("lead", lead).join(heads, ["parent", "slice"]).select("nid", "parent", "parent_conv_id", F.coalesce("lead", "later").alias("next_sibling"))
    firsts = children.groupBy(F.col("parent").alias("nid")).agg(F.count("*").alias("n_children"), F.min_by("nid", "conv_id").alias("first"))
    tree = nodes.select("nid", key, "conv_id", "depth", "n_convs", "chars").join(linked, "nid", "left").join(firsts, "nid", "left").withColumn("n_children", F.coalesce("n_children", zero))
    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("key"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))).alias("key"))
    return materialize(tree), ends.join(nodes.select(key, "nid"), "key").select("nid", "conv_id")


def tour_arcs(tree: DataFrame) -> DataFrame:
    """id, next: arc 2 * nid enters a node and 2 * nid + 1 leaves it; the root's last arc has no next."""
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    return tree.select(F.explode(F.array(
        F.struct(enter("nid").alias("id"), F.coalesce(enter("first"), leave("nid")).alias("next")),
        F.struct(leave("nid").alias("id"), F.coalesce(enter("next_sibling"), leave("parent")).alias("next")),
    )).alias("arc")).select("arc.*")


def _rank_few(rows: DataFrame) -> DataFrame:
    """id, after for a list of a bounded number of elements (id, to, dist), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [(i, t, d) for b in batches for i, t, d in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        before = {t: (i, d) for i, t, d in steps if t is not None}
        ids, after = [], []
        for at, _, n in (s for s in steps if s[1] is None):
            ids.append(at)
            after.append(n)
            while at in before:
                at, d = before[at]
                n += d
                ids.append(at)
                after.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(after, pa.int64())], names=["id", "after"])

    return rows.select("id", "to", "dist").coalesce(1).mapInArrow(run, "id long, after long")


def list_rank(arcs: DataFrame, every: int = 32, few: int = 10_000) -> DataFrame:
    """id, after: how many elements follow each in linked lists of arcs (id, next; null at an end).

    About one element in `every` is a splitter, by its hash. Pointers double until they reach the next splitter, for which about log2(every * ln(n))
    rounds do; the splitters then form a list of their own, shorter by that factor, which is ranked alike. Lists of few elements are walked in one task.
    """
    first = arcs.select("id", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist"))
    return _rank(*stored(first), every, few, 0)


def _rank(state: DataFrame, path: str, every: int, few: int, level: int) -> DataFrame:
    spark = state.sparkSession
    if state.count() <= few:
        return _rank_few(state)

    def splits(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), F.col(c)), F.lit(every)) == 0

    going = F.col("to").isNotNull() & ~splits("to")
    while not state.filter(going).isEmpty():
        jump = state.filter(~splits("id")).select(F.col("id").alias("at"), F.col("to").alias("then"), F.col("dist").alias("more"))
        moved = state.withColumn("at", F.when(going, F.col("to"))).join(jump, "at", "left")
        hit = F.col("more").isNotNull()
        step, new = stored(moved.select("id", F.when(hit, F.col("then")).otherwise(F.col("to")).alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
        discard(spark, path)
        state, path = step, new
    ranked = _rank(*stored(state.filter(splits("id"))), every, few, level + 1)
    known = materialize(ranked).select(F.col("id").alias("to"), "after")
    return state.join(known, "to", "left").select("id", (F.col("dist") + F.coalesce("after", F.lit(0))).alias("after"))


def subtree_sums(tree: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """nid and, for each weight, its sum over the node's subtree: the running sum at the arc that leaves it less that before the one that enters it."""
    ranked = materialize(list_rank(tour_arcs(tree)))
    n = ranked.count()
    width = max(1, math.isqrt(n))
    names = list(weights)
    entering = tree.select((F.col("nid") * 2).alias("id"), *[w.cast("long").alias(k) for k, w in weights.items()])
    placed = ranked.join(entering, "id", "left").select("id", (F.lit(n - 1) - F.col("after")).alias("pos"), *[F.coalesce(k, F.lit(0)).alias(k) for k in names])
    placed = materialize(placed.withColumn("bucket", F.floor(F.col("pos") / width)))
    before = Window.partitionBy("all").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in names]).withColumn("all", F.lit(0))
    base = sums.select("bucket", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"base_{k}") for k in names])
    inner = Window.partitionBy("bucket").orderBy("pos")
    run = placed.withColumns({f"run_{k}": F.sum(k).over(inner) for k in names}).join(base, "bucket")
    upto = lambda k: F.col(f"base_{k}") + F.col(f"run_{k}")
    part = lambda k: F.when(F.col("id") % 2 == 1, upto(k)).otherwise(F.col(k) - upto(k))
    return run.groupBy(F.floor(F.col("id") / 2).cast("long").alias("nid")).agg(*[F.sum(part(k)).alias(k) for k in names])


def ending_digests(ends: DataFrame) -> DataFrame:
    """nid, ends_sha256: of the numbers of the conversations that end at a node, ascending, joined by commas.

    SHA-256 reads its bytes in order, so a node's bytes pass through one task, but as a stream of joined chunks that is never held whole.
    """
    order = ends.select("conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id").withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK))
    chunked = materialize(order).select(F.struct("conv_id").alias("k"), "chunk").join(ends.select(F.struct("conv_id").alias("k"), "nid"), "k")
    texts = chunked.groupBy("nid", "chunk").agg(F.array_join(F.sort_array(F.collect_list("k.conv_id")).cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            ids, out = [], []
            for nid, text in zip(b.column("nid").to_pylist(), b.column("text"), strict=True):
                if nid != node:
                    if digest is not None:
                        ids.append(node)
                        out.append(digest.hexdigest())
                    node, digest = nid, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["nid", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["nid", "ends_sha256"])

    return texts.repartition("nid").sortWithinPartitions("nid", "chunk").select("nid", "text").mapInArrow(run, "nid long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the trie of rebuilt conversations.

    Nulls: see number_turns(). A repeated row is a turn of its own, a conversation without turns after rebuilding ends at the root, texts of any
    length are hashed whole, and an empty table has no trie, not even a root. Columns other than conv_id, turn, role and text play no part.
    """
    turns = materialize(number_turns(conversations))
    convs, rebuilt = rebuild(turns, share, most)
    tree, ends = build_trie(convs, materialize(prefix_keys(rebuilt)))
    sums = subtree_sums(tree, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return tree.join(sums, "nid").join(ending_digests(materialize(ends)), "nid", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
