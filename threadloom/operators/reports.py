"""Overviews, coverage rows, table profiles, dossiers and the filters behind them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import rules, scalars
from threadloom.operators import library
from threadloom.operators.digests import ordered_digest

# What marks a path, a text or a table.
ATTACHMENT = r"(?i)\.(pdf|docx?|pptx?|xlsx?|csv|txt|md|zip|rar|7z|py|ipynb|cpp|c|h|java|js|ts|tsx|html|css|png|jpe?g|gif|webp|bmp|mp4|mov|mkv|webm|mp3|wav|ogg|silk|amr)$"
DENIED_FILE = r"(?i)\.(log|xlog|dat|db|db-shm|db-wal|ldb|sst|tmp|bak|ini|json|map)$"
# Paths are matched with forward slashes.
DENIED_FOLDER = r"(?i)/(log-cache|avatar|Emoji|OnlineStatus|xplugin|XPlugin|upgrade|crash|cache|CacheStorage|Service Worker|Local Storage|Session Storage|xworker|publicLib|codecache|shared/ad|logs?|temp_log|tbs|DynamicResource|DynamicResourcePackage)/"
APP_USERS, APP_TEMP = r"(?i)/xwechat/radium/users/", r"(?i)/applet/local/[^/]+/temp/"
PICTURE, SCALED_PICTURE = r"(?i)\.(png|jpe?g|gif|webp|bmp)$", r"(?i)@[23]x|_[23]x|-1\.png$|-150\.png$|100\.png$"
SMALL_PICTURE = 128 * 1024
MEDIA_PREVIEWS = ("image", "video", "audio", "voice")
PLATFORM = r"(?i)userAgent|WindowsWechat|MicroMessenger|httpdns|cookie|slotid|traceid|browser:|log_version|CREATE TABLE|hookWx|GetWechatInfo|message_loop|messagecenter|errmsg|errcode|beacon"
SOURCE_APPS: rules.Rules = (("企业微信", "WXWork"), ("QQ", "Tencent Files|/AppData/Roaming/QQ(?:/|$)|/Tencent/QQ(?:/|$)"), ("微信", "WeChat|xwechat|微信"))
DIR_FOCUS: rules.Rules = (
    ("聊天数据库/索引", "/nt_db$|/roam(?:/|$)|/WeChat$"), ("QQ 应用数据/日志旁证", "/AppData/Roaming/QQ(?:/|$)|/Tencent/QQ(?:/|$)"), ("腾讯会议组件", "/WeMeet(?:/|$)"),
    ("聊天图片", "/Pic|/Image|/Thumb|/Ori"), ("聊天视频", "/Video"), ("语音", "/Ptt|/Voice|/Audio"), ("文件附件", "/File|/dataline|download"),
    ("新版微信数据", "/xwechat"), ("QQ 数据", "/Tencent Files"), ("企业微信数据", "/WXWork"),
)
TABLE_FOCUS: rules.Rules = (
    ("会议/日程历史", "meeting|calendar|historical_meetings|record_|participants|ai_summary"), ("用户/登录配置", "profile|user|login|account|authorize"),
    ("埋点/遥测", "beacon|event|report|monitor|behavior"), ("配置/缓存", "config|setting|cache|resource|res_"),
)
MESSAGE_FOCUS, OTHER_FOCUS = "疑似聊天/消息", "其他结构化数据"
MESSAGE_TABLE, MESSAGE_BODY, MESSAGE_ACTOR = r"(?i)(^|_)(msg|message|chat|conversations?|im)(_|$)", r"(^|_)(content|msg|message|body|text)(_|$)", r"(^|_)(talker|sender|receiver|from|to|peer|uin|uid|role)(_|$)"
TEXT_COLUMN = "(?i)text|char|clob|varchar|json|name|title|desc|content|msg|message|chat|url|data|value|profile|history|memo|remark"
SAMPLE_SIGNALS: rules.Rules = (
    ("链接", r"http|https|www\."), ("会议/日程", "会议|meeting|日程|calendar"), ("聊天线索", "msg|message|chat|content|聊天|群|好友"),
    ("技术", "ai|模型|prompt|代码|算法|开发"), ("学业", "课程|考试|学分|作业|医学|强基"), ("项目/比赛", "创业|项目|产品|商业|比赛|竞赛"),
)
NO_SAMPLE_SIGNAL = "结构化文本"
LOOKED_AT, SHOWN, SHOWN_IN_TABLE, SHOWN_LENGTH = 8, 4, 12, 360


def eligible_files(files: DataFrame) -> DataFrame:
    """Files worth keeping as attachments: an allowed kind outside caches and logs. Of an app's user folders only temporary
    ones count, and there no scaled pictures, and small pictures only where the name starts like a hash."""
    p = rules.slashed(F.col("path"))
    name = F.element_at(F.split(p, "/"), -1)
    small = ~name.rlike("(?i)^[a-f0-9]") & (F.col("size") < SMALL_PICTURE)
    app = p.rlike(APP_USERS) & (~p.rlike(APP_TEMP) | (p.rlike(PICTURE) & (name.rlike(SCALED_PICTURE) | small)))
    return files.filter(p.rlike(ATTACHMENT) & ~p.rlike(DENIED_FOLDER) & ~p.rlike(DENIED_FILE) & ~app)


def noise_files(files: DataFrame, valuable: str = rules.VALUABLE) -> DataFrame:
    """Empty files, program resources, and what lies in caches, is an app's resource or of a noisy kind, unless its path
    holds a valuable word. Chat media are never noise."""
    p = rules.slashed(F.col("path"))
    media = p.rlike(rules.CHAT_MEDIA) & rules.preview_for(p).isin(*MEDIA_PREVIEWS)
    worth = p.rlike(f"(?iu){valuable}")
    program = p.rlike(rules.PROGRAM_RESOURCE)
    other = F.when(worth, p.rlike(rules.HARD_NOISE) & p.rlike(rules.PROGRAM_FILE)).otherwise(p.rlike(rules.HARD_NOISE) | p.rlike(rules.APP_RESOURCE) | p.rlike(rules.NOISE_FILE))
    return files.filter((F.col("size") == 0) | (~media & (program | other)))


def platform_noise(c: Column) -> Column:
    return c.rlike(PLATFORM)


def high_confidence(signals: Column, label: str, c: Column, script: str = r"\p{IsHan}") -> Column:
    """Carries the label, is written in the script, and is no platform text."""
    return F.array_contains(signals, label) & c.rlike(script) & ~platform_noise(c)


def source_app(path: Column, apps: rules.Rules = SOURCE_APPS, default: str = "未知") -> Column:
    return rules.first_match(rules.slashed(path), apps, default)


def dir_focus(path: Column, table: rules.Rules = DIR_FOCUS, default: str = "候选目录") -> Column:
    return rules.first_match(rules.slashed(path), table, default)


def overview(rollup: DataFrame, contacts: DataFrame, archived: DataFrame, indexed: DataFrame, nuggets: DataFrame) -> DataFrame:
    """One row of totals over chats, files and insights."""
    parts = [
        rollup.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("msg_count"), F.lit(0)).alias("messages"), F.coalesce(F.sum("text_count"), F.lit(0)).alias("texts")),
        contacts.agg(F.count("*").alias("contacts")), archived.agg(F.count("*").alias("archived"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), indexed.agg(F.count("*").alias("indexed")),
        nuggets.agg(F.count_distinct("conv_id").alias("insight_conversations"), F.count("*").alias("nuggets")),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, columns, focus, suspected_message, samples (array of column, value, signals): one aggregate per table.

    Samples are of columns that hold text by their name or type. Of each column eight values are looked at, for each of eight hash functions the one
    of the smallest hash: a sample of the different values that partial aggregates merge and that does not depend on the order of rows.
    Values of two characters or more are shown, four of a column and twelve of a table at most, cut at 360 characters.
    """
    rows = []
    for name, df in tables.items():
        says = lambda p: any(re.search(p, c.lower()) for c in df.columns)  # noqa: B023, E731
        message = bool(re.search(MESSAGE_TABLE, name)) and says(MESSAGE_BODY) and says(MESSAGE_ACTOR)
        focus = F.coalesce(rules.first_match(F.lit(" ".join([name, *df.columns])), TABLE_FOCUS, None), F.lit(MESSAGE_FOCUS if message else OTHER_FOCUS))
        texts = [c for c, t in df.dtypes if t != "binary" and not t.startswith(("array", "map", "struct")) and re.search(TEXT_COLUMN, f"{name} {c} {t}")]
        text_of = {c: F.trim(F.regexp_replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("\0"), F.lit("")), r"\s+", " ")) for c in texts}
        smallest = [F.min(F.when(v.isNotNull(), F.struct(F.xxhash64(F.lit(k), v).alias("h"), v.alias("v")))).alias(f"s{i}_{k}") for i, v in enumerate(text_of.values()) for k in range(LOOKED_AT)]
        got = df.agg(F.count("*").alias("rows"), *smallest)
        shown = []
        for i, c in enumerate(texts):
            values = F.array_distinct(F.array_compact(F.array(*[F.col(f"s{i}_{k}.v") for k in range(LOOKED_AT)])))
            kept = F.slice(F.filter(values, lambda v: F.length(v) >= 2), 1, SHOWN)
            shown.append(F.transform(kept, lambda v: F.struct(F.lit(c).alias("column"), F.substring(v, 1, SHOWN_LENGTH).alias("value"), rules.signals(v, SAMPLE_SIGNALS, NO_SAMPLE_SIGNAL).alias("signals"))))  # noqa: B023
        none = F.array().cast("array<struct<column:string,value:string,signals:array<string>>>")
        samples = F.slice(F.concat(none, *shown), 1, SHOWN_IN_TABLE)
        rows.append(got.select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), focus.alias("focus"), samples.alias("samples")).withColumn("suspected_message", F.col("focus") == MESSAGE_FOCUS))
    return reduce(DataFrame.unionByName, rows)


def summary_row(files: DataFrame, texts: DataFrame, databases: DataFrame) -> DataFrame:
    """One row of coverage: files and bytes, texts by quality, databases that could be read."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("ext").alias("kinds"))
    t = texts.agg(*[F.count_if(F.col("quality") == q).alias(f"{q}_texts") for q in ("high", "medium", "low")])
    d = databases.agg(F.count("*").alias("databases"), F.count_if("readable").alias("readable"))
    return f.crossJoin(t).crossJoin(d)  # one row each


def board_rows(summary: DataFrame) -> DataFrame:
    """board, line: what the coverage row says, a line per board."""
    n = lambda c: F.col(c).cast("string")
    lines = [("files", F.concat_ws(" ", n("files"), F.lit("files,"), n("bytes"), F.lit("bytes"))), ("texts", F.concat_ws("/", n("high_texts"), n("medium_texts"), n("low_texts"))), ("databases", F.concat_ws("/", n("readable"), n("databases")))]
    return summary.select(F.inline(F.array(*[F.struct(F.lit(k).alias("board"), v.alias("line")) for k, v in lines])))


def clue_dossier(sources: list[DataFrame], k: int = 160, export: str = library.CHAT_EXPORT) -> DataFrame:
    """Snippets of several sources (source_type, path, signal, excerpt), without platform texts, grouped, scored and ranked, with a verdict on each group."""
    s = reduce(DataFrame.unionByName, sources).filter(~platform_noise(F.col("excerpt")))
    groups = library.clue_groups(s).withColumn("verdict", library.clue_verdict(F.col("source_type"), F.col("path"), F.col("signals"), export))
    return groups.orderBy(F.desc("score"), "path", "source_type").limit(k)


def knowledge_tables(courses: DataFrame, nuggets: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """Forecast courses by credits, and a category's nuggets by importance."""
    return courses.filter("kind = 'forecast'").orderBy(F.desc("credits"), "name"), nuggets.filter(F.col("category") == category).orderBy(F.desc("importance"), "conv_id", "canonical_seq")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def availability(version: Column, state: Column, preview: Column) -> Column:
    """What a viewer can show of an artifact, for both layouts of its state columns."""
    known = ("not_attempted", "source_missing", "cdn_only", "failed", "source_ambiguous", "hash_mismatch")
    v2 = F.when(state == "ready", "ready").when((state == "thumbnail_only") & (preview == "thumbnail_only"), "thumbnail_only").when((preview == "unavailable") & state.isin(*known), state)
    v1 = F.when((state == "exported") & (preview == "ready"), "ready").when((state == "exported") & (preview == "unsupported_codec"), "unsupported_codec").when((state == "thumbnail_only") & (preview == "thumbnail_only"), "thumbnail_only").when((state == preview) & state.isin(*known), state)
    return F.coalesce(F.when(version == 2, v2).otherwise(v1), F.lit("source_unavailable"))


def asset_state(match: Column, name: Column, cdn_only: Column, preview: Column) -> Column:
    """struct(state, preview_status, reason) of a resource's match."""
    dat, still = name.rlike(r"(?i)\.dat$"), (preview == "video") & name.rlike(r"(?i)\.(png|jpe?g|gif|webp)$")
    found = match.isin("exact", "filename_only")
    state = F.when(match == "missing", F.when(cdn_only, "cdn_only").otherwise("source_missing")).when(~found | dat, "not_attempted").when(still, "thumbnail_only").otherwise("ready")
    reason = (
        F.when(match == "ambiguous", "multiple_local_candidates").when(match == "size_mismatch", "local_candidate_size_mismatch")
        .when(match == "missing", F.when(cdn_only, "remote_cdn_reference_without_local_cache").otherwise("local_source_not_found")).when(found & dat, "encrypted_wechat_dat_requires_materialization")
    )
    return F.struct(state.alias("state"), F.when(state.isin("ready", "thumbnail_only"), state).otherwise("unavailable").alias("preview_status"), reason.alias("reason"))


def asset_scope(messages: DataFrame, inventory: DataFrame) -> DataFrame:
    """username, conv_id of one snapshot. Fails unless it has one owner, one conversation per username, and an inventory row for every shard.

    messages: owner, username, conv_id, source_db; inventory: source_db, domain, parsed.
    """
    convs = messages.select("owner", "username", "conv_id").distinct()
    owners = convs.select("owner").distinct().limit(2).count()
    if owners != 1:
        raise ValueError(f"the snapshot has {'no owner' if not owners else 'several owners'}")
    twice = convs.groupBy("username").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['username']!r} names several conversations")
    have = inventory.filter(F.col("domain").isin("regular", "biz") & (F.col("parsed") > 0)).select("source_db")
    lost = messages.select("source_db").distinct().join(have, "source_db", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"shard {lost[0]['source_db']!r} has no inventory")
    return convs.select("username", "conv_id")


def resource_artifacts(aligned: DataFrame, matched: DataFrame, resources: DataFrame) -> DataFrame:
    """resource_id, message_uid, name, preview, category, status: alignments and file matches made into artifact rows."""
    j = resources.select("resource_id", "name").join(aligned.select("resource_id", "verdict", "message_uid"), "resource_id", "left").join(matched.select("resource_id", F.col("status").alias("match"), "path"), "resource_id", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), F.element_at(F.split("path", "/"), -1), F.lit("attachment"))
    state = asset_state(F.coalesce("match", F.lit("missing")), name, F.lit(False), rules.preview_for(name))
    return j.select("resource_id", F.when(F.col("verdict") == "exact", F.col("message_uid")).alias("message_uid"), name.alias("name"), rules.preview_for(name).alias("preview"), F.when(F.col("verdict") == "exact", "confirmed").otherwise("quarantined").alias("status"), state["state"].alias("state"))


def voice_artifacts(aligned: DataFrame, messages: DataFrame) -> DataFrame:
    """voice_id, message_uid, status; and a placeholder without voice_id for every voice message that no row points at."""
    v = messages.filter("type = 34").select("message_uid")
    rest = v.join(aligned.filter("message_uid IS NOT NULL").select("message_uid"), "message_uid", "left_anti")
    return aligned.select("voice_id", "message_uid", "status").unionByName(rest.select(F.lit(None).cast(aligned.schema["voice_id"].dataType).alias("voice_id"), "message_uid", F.lit("placeholder").alias("status")))


def content_digests(files: DataFrame) -> DataFrame:
    """(path, content) of present files -> path, sha256; equal paths are read once."""
    return files.dropDuplicates(["path"]).select("path", F.sha2("content", 256).alias("sha256"))


def daily_media(messages: DataFrame, artifacts: DataFrame, zone: str) -> DataFrame:
    """conv_id, day, messages, media: messages by day with their confirmed artifacts only."""
    a = artifacts.filter("status = 'confirmed' AND message_uid IS NOT NULL").groupBy("message_uid").agg(F.count("*").alias("n"))
    day = scalars.archive_day(F.col("occurred_at_epoch_s"), zone)
    return messages.join(a, "message_uid", "left").groupBy("conv_id", day.alias("day")).agg(F.count("*").alias("messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("media"))


def source_hash(messages: DataFrame) -> DataFrame:
    """conv_id, source_hash: the hash of a conversation's uids in order."""
    return ordered_digest(messages, "conv_id", ["canonical_seq"], F.col("message_uid"), "source_hash", place=F.col("canonical_seq"))


def newest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
