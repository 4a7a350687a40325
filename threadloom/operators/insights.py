"""Incremental insights: what has grown, what of it is worth keeping, and the boards made of that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import rules


def plan_delta(convs: DataFrame, states: DataFrame, min_growth: int = 8) -> DataFrame:
    """conv_id, growth, plan: new, grown (by min_growth or more), accumulated (by fewer) or unchanged."""
    j = convs.select("conv_id", "text_count").join(states.select("conv_id", "analyzed_text_count"), "conv_id", "left")
    growth = F.col("text_count") - F.coalesce("analyzed_text_count", F.lit(0))
    plan = F.when(F.col("analyzed_text_count").isNull(), "new").when(growth >= min_growth, "grown").when(growth > 0, "accumulated").otherwise("unchanged")
    return j.select("conv_id", growth.alias("growth"), plan.alias("plan"))


def bind_cursors(states: DataFrame, messages: DataFrame) -> DataFrame:
    """states whose cursor (conv_id, analyzed_last_message_uid) is one text message: + cursor_seq; others keep null."""
    m = messages.filter(F.length("text") > 0).groupBy("conv_id", F.col("message_uid").alias("analyzed_last_message_uid")).agg(F.count("*").alias("n"), F.max("canonical_seq").alias("s"))
    return states.join(m, ["conv_id", "analyzed_last_message_uid"], "left").withColumn("cursor_seq", F.when(F.col("n") == 1, F.col("s"))).drop("n", "s")


def delta_rows(messages: DataFrame, plan: DataFrame, cursors: DataFrame) -> DataFrame:
    """Text messages past the cursor, of conversations that are new or grown."""
    due = plan.filter(F.col("plan").isin("new", "grown")).select("conv_id", "plan").join(cursors.select("conv_id", "cursor_seq"), "conv_id", "left")
    return messages.filter(F.length("text") > 0).join(due, "conv_id").filter(F.col("canonical_seq") > F.coalesce("cursor_seq", F.lit(-1))).drop("cursor_seq")


def preferred_state(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("username").orderBy(F.desc("last_time"), F.desc("text_count"), F.desc("analyzed_at"), "conv_id")
    return states.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def top_nuggets(messages: DataFrame, n: int = 5, table: rules.Rules = rules.INSIGHT_CATEGORIES, advice: str = rules.ADVICE) -> DataFrame:
    """conv_id, canonical_seq, rank, category, score, title, content, importance: a conversation's best messages. The per-task cut before the shuffle keeps long conversations cheap."""
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    m = messages.filter(rules.distillable(F.col("text"))).withColumn("t", t).withColumn("score", rules.insight_score(F.col("text"), table, advice))
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "canonical_seq")
    top = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.select("conv_id", "canonical_seq", "rank", rules.first_match(F.col("t"), table, rules.OTHER).alias("category"), "score", rules.insight_title(F.col("t")).alias("title"), rules.cut(F.col("t"), 140).alias("content"), rules.importance(F.col("score")).alias("importance"))


def reconcile_insights(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """current (conv_id, username), legacy (legacy_id, username, owner_ok) -> conv_id, legacy_id. A username that two current conversations share is an error."""
    twice = current.groupBy("username").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several conversations are called {twice[0]['username']!r}")
    return legacy.filter("owner_ok").join(current, "username").select("conv_id", "legacy_id")


def merge_insights(copies: DataFrame) -> DataFrame:
    """(conv_id, item) rows of any number of copies -> distinct, one comma-joined line per conversation."""
    return copies.distinct().groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


def insight_boards(nuggets: DataFrame, cap: int = 36) -> DataFrame:
    """category, board: markdown in three bands of importance, at most cap nuggets."""
    w = Window.partitionBy("category").orderBy(F.desc("importance"), F.desc("score"), "conv_id", "canonical_seq")
    top = nuggets.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    band = F.when(F.col("importance") >= 4, "## high").when(F.col("importance") >= 2, "## middle").otherwise("## low")
    g = top.groupBy("category", band.alias("band")).agg(F.max("importance").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("ls"))
    return g.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("o"), F.concat_ws("\n", "band", "ls").alias("t")))), lambda x: x["t"]), "\n").alias("board"))


def delta_digests(delta: DataFrame, cap: int = 52_000) -> DataFrame:
    line = F.concat(F.coalesce("sender", F.lit("?")), F.lit(": "), "text")
    # Lines that start beyond the cap are dropped before any array is made, so an array holds cap characters and one line at most.
    before = Window.partitionBy("conv_id").orderBy("canonical_seq").rowsBetween(Window.unboundedPreceding, -1)
    delta = delta.withColumn("__so", F.coalesce(F.sum(F.coalesce(F.length(line), F.lit(0)) + 1).over(before), F.lit(0))).filter(F.col("__so") <= cap)
    g = delta.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("canonical_seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("d"))
    return g.select("conv_id", F.substring(F.concat_ws("\n", F.concat(F.lit("# "), "conv_id"), "d"), 1, cap).alias("digest"))


def refresh_insights(messages: DataFrame, convs: DataFrame, states: DataFrame, min_growth: int = 8, **table) -> tuple[DataFrame, DataFrame]:
    """Nuggets of what grew, and the states after it. Fails if the delta's rows are not the growth that the plan counts."""
    plan = plan_delta(convs, states, min_growth)
    delta = delta_rows(messages, plan, bind_cursors(states, messages))
    want, have = plan.filter(F.col("plan").isin("new", "grown")).agg(F.coalesce(F.sum("growth"), F.lit(0))).first()[0], delta.count()
    if want != have:
        raise ValueError(f"the delta holds {have} rows, the plan counts {want}")
    last = delta.groupBy("conv_id").agg(F.max_by("message_uid", "canonical_seq").alias("uid"))
    after = convs.select("conv_id", "text_count").join(last, "conv_id").select("conv_id", F.col("text_count").alias("analyzed_text_count"), F.col("uid").alias("analyzed_last_message_uid"))
    return top_nuggets(delta, **table), after.unionByName(states.select("conv_id", "analyzed_text_count", "analyzed_last_message_uid").join(after, "conv_id", "left_anti"))


def insights_response(nuggets: DataFrame) -> DataFrame:
    return nuggets.groupBy("category").agg(F.count("*").alias("nuggets"), F.count_distinct("conv_id").alias("conversations"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "conv_id", "canonical_seq", "title"))), lambda x: x["title"]), 1, 5), " / ").alias("top"))
