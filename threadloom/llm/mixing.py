"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_bucket, running_offsets, text_key

#: Weight of the first, second and third source by code point, and so on in turn.
WEIGHTS = (5, 2, 1)
#: Schedules that go with the weights: (time, relative intensity) knots, linear in between.
#: What weighs most leads the first half of training, what weighs least the second.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def source_targets(sizes: DataFrame, share: float = 1.0, cap: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """g, source, source_size, nth (class of weight), target; one row per source.

    sizes: one row per source at least (source, size); they are summed first. Targets are
    weight * level, stopped at cap * source_size; the level is the one at which they add
    up to share of all sizes, which is what resharing the excess by weight again and again comes to.
    """
    per = sizes.groupBy(text_key(F.col("source")).alias("g")).agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # over the sums, one row per source
    nth = per.withColumn("nth", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    w = nth.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("nth") + 1).cast("int")))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    filled = w.withColumn("fill", F.col("source_size") * cap / F.col("w")).withColumn("total", total)
    # In the order in which sources fill up: those before a row are capped when the level reaches it.
    up_to = Window.orderBy("fill", "g").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("fill", "g").rowsBetween(0, Window.unboundedFollowing)
    tried = filled.withColumn("level", (F.col("total") - F.coalesce(F.sum("source_size").over(up_to), F.lit(0)) * cap) / F.sum("w").over(after))
    # The level is that of the first row which it does not fill up; beyond it the trial levels are at most its fill too.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "g", "level"))).over(Window.partitionBy())
    return tried.withColumn("at", level).select("g", "source", "source_size", "nth", F.when(F.col("at").isNull() | (F.struct("fill", "g") < F.struct("at.fill", "at.g")), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("w") * F.col("at.level")).alias("target"))


def _schedule_column(schedules: tuple) -> Column:
    """Per class: knots (t, w, u), w scaled to an integral of 1 and u the integral so far."""
    out = []
    for knots in schedules:
        area, so_far = 0.0, [0.0]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            area += (t1 - t0) * (w0 + w1) / 2
            so_far.append(area)
        out.append(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w / area).alias("w"), F.lit(u / area).alias("u")) for (t, w), u in zip(knots, so_far, strict=True)]))
    return F.array(*out)


def invert_demand(knots: Column, u: Column) -> Column:
    """The time in 0 to 1 by which the schedule has asked for the share u of its tokens."""
    n = F.size(knots)
    i = F.least(F.greatest(F.size(F.filter(knots, lambda k: k["u"] <= u)), F.lit(1)), n - 1)
    a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
    slope, rest = (b["w"] - a["w"]) / (b["t"] - a["t"]), F.greatest(u - a["u"], F.lit(0.0))
    # w t + slope t^2 / 2 = rest, in the form that also holds for slope 0
    return F.least(b["t"], a["t"] + 2 * rest / (a["w"] + F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * rest, F.lit(0.0)))))


def plan_curriculum(docs: DataFrame, n_docs: int, share: float = 1.0, cap: int = 3, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES) -> DataFrame:
    """docs (with doc_id, source, size, th: a hash of the text, as text) + source_size, target, copies and positions (array of double, one per copy).

    A source's documents stand in a line in the order of a hash of doc_id and th, so rows that share or lack a
    doc_id spread too; rows equal in both may swap places, which changes no count. The line repeats; a
    copy is taken while its middle lies within the target, so what is taken differs
    from the target by half a document at most. The middle, as a share of the target,
    is the demand at which the copy is due; inverting the schedule's integral gives its position.
    """
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("th")))
    keyed = docs.withColumn("g", text_key(F.col("source"))).withColumn("h", h).withColumn("b", hash_bucket(F.col("h"), n_docs))
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("size")), share, cap, weights).drop("source")
    line = running_offsets(keyed, "g", "b", ["h", "doc_id", "size"], "size", "start", targets)
    middle = F.col("start") + F.col("size") / F.lit(2.0)
    fits = (F.col("size") > 0) & (middle <= F.col("target"))
    copies = F.when(fits, F.least(F.floor((F.col("target") - middle) / F.col("source_size")) + 1, F.lit(cap))).otherwise(0).cast("int")
    knots = F.element_at(_schedule_column(schedules), (F.col("nth") + 1).cast("int"))
    due = lambda i: invert_demand(F.col("knots"), (middle + i * F.col("source_size")) / F.col("target"))
    placed = line.withColumn("copies", copies).withColumn("knots", knots)
    return placed.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), due)).otherwise(F.array().cast("array<double>"))).drop("g", "b", "h", "th", "nth", "knots", "start")


def mix_sizes(sizes: DataFrame, n_docs: int, **settings) -> DataFrame:
    """doc_id, source, size, th -> doc_id, size, source_size, target, taken, copies, position (of the first copy), range-sorted by position.

    A null source is a source of its own; documents without words have size 0 and are never
    taken; rows that repeat a doc_id are documents of their own. An empty table gives an empty one.
    """
    got = plan_curriculum(sizes.select("doc_id", "source", "size", "th"), n_docs, **settings)
    out = got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, range-sorted by training position.

    Columns are those of docs. Documents that are not taken, as the targets have no room for them, are left out.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("th"))
    got = plan_curriculum(rows, docs.count(), **settings)
    at = got.select("row", F.explode("positions").alias("position"))
    return at.repartitionByRange("position", "row.doc_id").sortWithinPartitions("position", "row.doc_id").select("row.*")
