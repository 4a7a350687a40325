"""The file library: statistics, candidates, archive plans, clues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import rules, scalars
from threadloom.operators.archive import archive_issues, plan_archive  # noqa: F401


def ext_stats(files: DataFrame, k: int = 80) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "ext").limit(k)


def root_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("newest"), F.min("modified").alias("oldest"))


def library_counts(files: DataFrame, keywords: rules.Rules) -> DataFrame:
    c = rules.classify_file(F.col("path"), keywords)
    return files.groupBy(c["category"].alias("category"), rules.preview_for(F.col("path")).alias("preview")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def download_groups(files: DataFrame) -> DataFrame:
    """by (ext or name), key, files, bytes."""
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("key")) for c in ("ext", "name")])).alias("g")
    return files.select(both, "size").groupBy("g.by", "g.key").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def latest_serial(files: DataFrame) -> DataFrame:
    """Per folder and stem the file with the highest `(n)`; of equals the later one."""
    s = rules.duplicate_stem(F.col("name"))
    d = files.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("stem", s)
    w = Window.partitionBy("folder", "stem.key").orderBy(F.desc("stem.serial"), F.desc("file_id"))
    return d.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "stem", "folder")


def dedupe_candidates(cands: DataFrame) -> DataFrame:
    w = Window.partitionBy("name", "size", "preview").orderBy(F.desc("modified"), "file_id")
    return cands.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def unarchived(cands: DataFrame, archive: DataFrame) -> DataFrame:
    """Candidates that the archive has neither by path, nor by hash, nor, for pictures, videos and sound, as another size of the same file."""
    a = archive.select(rules.path_key(F.col("path")).alias("pk")).distinct()
    h = archive.filter("sha256 IS NOT NULL").select(F.col("sha256").alias("hk")).distinct()
    v = archive.select(rules.media_variant_key(F.col("path")).alias("vk")).filter("vk <> ''").distinct()
    left = cands.join(a, rules.path_key(F.col("path")) == F.col("pk"), "left_anti").join(h, F.col("sha256") == F.col("hk"), "left_anti")
    return left.join(v, rules.media_variant_key(F.col("path")) == F.col("vk"), "left_anti")


# Kinds of previews, what each thing a file is or is not counts, and the levels and bucket of what is left.
VALUED = ("pdf", "docx", "sheet", "presentation", "archive", "markdown", "text", "code", "json", "image", "video", "audio", "voice")
DOCUMENTS = ("pdf", "docx", "sheet", "presentation", "archive", "markdown")
MEDIA, STRUCTURED = ("image", "video", "audio", "voice"), ("text", "code", "json")
USER_DATA, WORK_DATA = "(?i)Tencent Files|WeChat Files|xwechat", "(?i)WXWork"
PLUS = (("document", 45, "文档/表格/压缩包"), ("chat_media", 38, "聊天媒体目录"), ("archive", 12, "可打开压缩包目录"), ("readable", 12, "可读文本/结构化数据"), ("keyword", 30, "路径命中价值关键词"), ("user_data", 8, "微信/QQ 用户数据路径"), ("work_data", 4, "企业微信路径"), ("large", 4, "文件体积较大"))
MINUS = (("hard_noise", 30), ("app_resource", 18), ("program", 42), ("tencent_program", 42), ("noisy_kind", 20))
LEAST, MEDIUM, HIGH, REVIEW = 24, 42, 70, "复核"


def file_traits(files: DataFrame) -> dict[str, Column]:
    """What counts for or against a file (path, relative_path, size, preview), each as a condition."""
    p, preview, size = rules.slashed(F.col("path")), F.col("preview"), F.col("size")
    shown = F.concat_ws("\n", F.coalesce("relative_path", F.lit("")), F.element_at(F.split(p, "/"), -1))
    return {
        "document": preview.isin(*DOCUMENTS), "media": preview.isin(*MEDIA), "chat_media": p.rlike(rules.CHAT_MEDIA) & preview.isin(*MEDIA), "archive": preview == "archive",
        "readable": preview.isin(*STRUCTURED) & size.between(4096, 2 * 1024 * 1024), "keyword": shown.rlike(f"(?iu){rules.VALUABLE}"), "user_data": p.rlike(USER_DATA), "work_data": p.rlike(WORK_DATA),
        "large": size >= 1024 * 1024, "hard_noise": p.rlike(rules.HARD_NOISE), "app_resource": p.rlike(rules.APP_RESOURCE), "program": p.rlike(rules.QQ_PROGRAM),
        "tencent_program": p.rlike(rules.TENCENT_PROGRAM), "noisy_kind": p.rlike(rules.NOISE_FILE), "program_file": p.rlike(rules.PROGRAM_FILE),
    }


def noise_of(t: dict[str, Column]) -> Column:
    """Whether a file of these traits is noise: empty, a program's resource, or in a noisy place or of a noisy kind without a valuable word. Chat media are not."""
    worth = t["keyword"] & ~t["program_file"]
    return (F.col("size") == 0) | (~t["chat_media"] & (t["program"] | t["tencent_program"] | (~worth & (t["hard_noise"] | (~t["keyword"] & (t["app_resource"] | t["noisy_kind"]))))))


def scored_candidates(files: DataFrame, archive: DataFrame) -> DataFrame:
    """files (path, root, relative_path, size, modified, sha256) that archive (path, sha256) does not hold, scored by what they are and where:
    with preview, score (LEAST or more), level, bucket, reasons and action; copies of one name, size and preview once, the newest (ties: the last by path)."""
    f = files.withColumn("preview", rules.preview_for(F.col("path"))).filter(F.col("preview").isin(*VALUED))
    # Traits are columns, so that each pattern is looked for once.
    traits = F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in file_traits(f).items()])
    f = f.withColumn("__t", traits)
    t = {k.name: F.col("__t")[k.name] for k in f.schema["__t"].dataType.fields}
    f = unarchived(f.filter(~F.coalesce(noise_of(t), F.lit(False))), archive)
    points = [F.when(t[k], n).otherwise(0) for k, n, _ in PLUS] + [F.when(t[k], -n).otherwise(0) for k, n in MINUS]
    f = f.withColumn("score", sum(points[1:], points[0])).filter(F.col("score") >= LEAST)
    name = F.element_at(F.split(rules.slashed(F.col("path")), "/"), -1)
    newest = Window.partitionBy("__name", "size", "preview").orderBy(F.desc("modified"), F.desc("path"))
    f = f.withColumn("__name", F.lower(F.regexp_replace(name, r"(?i)(?:\((\d+)\))?(\.[^.]+)$", "$2")))
    f = f.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__name")
    # What only describes a candidate is made for those that are left.
    level = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    action = F.when(F.col("preview").isin(*DOCUMENTS) | (F.col("score") >= HIGH), "archive_candidate").otherwise("review")
    reasons = F.array_compact(F.array(*[F.when(t[k], F.lit(why)) for k, _, why in PLUS]))
    bucket = F.replace(rules.classify_file(F.col("path"))["category"], F.lit("未归类"), F.lit(REVIEW))
    return f.withColumns({"level": level, "action": action, "reasons": reasons, "bucket": bucket}).drop("__t")


def value_candidates(files: DataFrame, archive: DataFrame, k: int = 600) -> DataFrame:
    """The k best of scored_candidates(): by score, then size, then path."""
    return scored_candidates(files, archive).orderBy(F.desc("score"), F.desc("size"), "path").limit(k)


def candidate_totals(cands: DataFrame) -> DataFrame:
    """bucket, preview, level, files."""
    return cands.groupBy("bucket", "preview", "level").agg(F.count("*").alias("files"))


def source_text_index(docs: DataFrame, table: rules.Rules, k: int | None = None) -> DataFrame:
    """doc_id, signals, quality (high, medium, low), excerpt."""
    # Each step is a column of its own, so that a text is stripped once and searched once.
    plain = docs.select("doc_id", F.trim(scalars.single_spaced(scalars.strip_html(F.col("text")))).alias("t"))
    s = plain.select("*", rules.signals(F.col("t"), table, "none").alias("s"))
    counted = s.select("*", F.size(F.filter("s", lambda x: x != "none")).alias("n"), F.length("t").alias("size"))
    quality = F.when((F.col("n") >= 2) & (F.col("size") >= 400), "high").when((F.col("n") >= 1) & (F.col("size") >= 80), "medium").otherwise("low")
    out = counted.select("doc_id", F.array_join("s", "|").alias("signals"), quality.alias("quality"), F.substring("t", 1, 160).alias("excerpt"))
    return out if k is None else out.orderBy("quality", "doc_id").limit(k)


def signal_counts(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(col).alias("signal")).groupBy("signal").agg(F.count("*").alias("rows"))


def export_conversations(msgs: DataFrame, table: rules.Rules, highlights: int = 40, default: str = "none") -> DataFrame:
    """(title, source, n, sender, text) -> title, messages, sources, participants (sorted arrays), signals (map of counts), highlights (the first texts, by source and n, that carry a signal)."""
    s = msgs.withColumn("s", rules.signals(F.col("text"), table, default))
    g = s.groupBy("title").agg(F.count("*").alias("messages"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("sender")).alias("participants"))
    counts = s.select("title", F.explode("s").alias("l")).groupBy("title", "l").agg(F.count("*").alias("k"))
    sig = counts.groupBy("title").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "k")))).alias("signals"))
    top = s.filter(~F.array_contains("s", default)).withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("source", "n")))
    top = top.filter(F.col("r") <= highlights).groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("highlights"))
    return g.join(sig, "title").join(top, "title", "left").withColumn("highlights", F.coalesce("highlights", F.array().cast("array<string>")))


def accept_exports(per_file: DataFrame) -> DataFrame:
    """per_file: path, messages, named (boolean), signals -> those that look like a chat: 20 messages under a telling name, 8 with two signals, or 50."""
    return per_file.filter(((F.col("messages") >= 20) & F.col("named")) | ((F.col("messages") >= 8) & (F.col("signals") >= 2)) | (F.col("messages") >= 50))


def cap_per_path(df: DataFrame, n: int = 2, order: str = "canonical_seq", path: str = "path") -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(path).orderBy(order))).filter(F.col("n") <= n).drop("n")


def clue_groups(snippets: DataFrame, excerpts: int = 8) -> DataFrame:
    """(source_type, path, signal, excerpt) -> source_type, path, signals, excerpts (number kept), score, band, texts (the excerpts kept)."""
    s = snippets.distinct()
    w = Window.partitionBy("source_type", "path").orderBy("excerpt")
    e = s.select("source_type", "path", "excerpt").distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= excerpts)
    e = e.groupBy("source_type", "path").agg(F.count("*").alias("excerpts"), F.array_sort(F.collect_list("excerpt")).alias("texts"))
    g = s.groupBy("source_type", "path").agg(F.array_join(F.array_sort(F.collect_set("signal")), "|").alias("signals"), F.count_distinct("signal").alias("k"))
    score = F.col("k") * 10 + F.col("excerpts") * 2
    band = F.when(score >= 40, "high").when(score >= 25, "medium").otherwise("low")
    return g.join(e, ["source_type", "path"]).select("source_type", "path", "signals", "excerpts", score.alias("score"), band.alias("band"), "texts")


# What is said of a group of clues, by its path or its signals, and the sections of a synthesis.
CHAT_EXPORT = "聊天导出"
EXPORT_VERDICT = "可直接进入人物/群组级聊天总结。"
PATH_VERDICTS: rules.Rules = (
    ("QQ NT 重点消息库或索引候选；当前只能证明存在封装/索引线索，不能把片段当完整聊天正文。", "nt_msg|group_msg|buddy_msg|fts|file_assistant"),
    ("微信/xwechat WebView、缓存或小程序数据线索；可作为访问痕迹和上下文旁证。", "xwechat|radium|weixin"),
    ("企业微信/腾讯会议日志或数据库线索；多数是会议、WebView、邮箱或平台行为，不等同于私人聊天正文。", "WXWork|WeMeet"),
)
SIGNAL_VERDICTS = (
    ("含学业相关可读线索，适合进入资料复核和课程行动整理。", ("学业",)),
    ("含技术/API/配置线索，适合作为技术价值材料复核。", ("技术", "AI/技术")),
)
OTHER_VERDICT = "保留为聊天/内容候选线索，需结合源文件右侧预览继续复核。"
TECHNICAL = "AI|技术|接口|代码|模型|算法|开发|架构|配置|api|prompt|llm|openai|claude|python|typescript|react"
ACADEMIC = "学业|学习|课程|作业|考试|复习|基医|强基|医学|生物|化学|物理|高数|英语|思政|实验|资料"
PHILOSOPHY = "哲理|方法|认知|复盘|原则|选择|长期|价值|意义|成长|判断|情绪|自律|行动|计划|目标"
BOUNDARY = "会议|日程|平台线索|缓存|数据库|索引|日志|WebView|wemeet|meeting"


def clue_verdict(source_type: Column, path: Column, signals: Column, export: str = CHAT_EXPORT) -> Column:
    """What a group of clues is good for. Platform texts are taken out before groups are made, so no verdict is on them."""
    has = F.split(signals, r"\|")
    by_signal = F.coalesce(*[F.when(F.arrays_overlap(has, F.array(*map(F.lit, names))), text) for text, names in SIGNAL_VERDICTS])
    return F.when(source_type == export, EXPORT_VERDICT).otherwise(F.coalesce(rules.first_match(path, PATH_VERDICTS, None), by_signal, F.lit(OTHER_VERDICT)))


def clue_synthesis(groups: DataFrame, export: str = CHAT_EXPORT) -> DataFrame:
    """section, rank, path, source_type, score: six sections of groups (with verdict), each its own filter and length, best first."""
    whole = F.concat_ws("\n", F.replace("signals", F.lit("|"), F.lit(" ")), "verdict", F.array_join("texts", "\n"), "path")
    exported = F.col("source_type") == export
    says = lambda c, p: c.rlike(f"(?iu){p}")
    sections = (
        ("confirmed-conversations", exported, 24), ("technical-value", says(whole, TECHNICAL), 24), ("academic-material", says(whole, ACADEMIC), 18),
        ("philosophy-method", exported & says(F.array_join("texts", "\n"), PHILOSOPHY), 18), ("source-boundaries", ~exported & says(whole, BOUNDARY), 18),
        ("high-value-review", F.col("band") == "high", 24),
    )
    marks = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("section"), F.lit(k).alias("k"))) for name, c, k in sections]))
    w = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("excerpts"), "path", "source_type")
    ranked = groups.select(F.explode(marks).alias("m"), "path", "source_type", "score", "excerpts").select("m.section", "m.k", "path", "source_type", "score", "excerpts")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k")).select("section", "rank", "path", "source_type", "score")


def visible_text(files: DataFrame, least: int = 12) -> DataFrame:
    """(path, content binary) -> path, encoding, run: printable runs of at least `least` characters, in UTF-8 and UTF-16LE.

    Bytes that are no UTF-8 end a run. As UTF-16LE every file is read as it stands, an odd last byte left out.
    A run that only noise makes up is left out; one that a file holds twice is one row.
    """
    printable = F.lit(r"[\x20-\x7E\p{L}\p{N}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]{%d,}" % least)

    def runs(text: Column, name: str) -> DataFrame:
        found = files.select("path", F.lit(name).alias("encoding"), F.explode(F.regexp_extract_all(text, printable, F.lit(0))).alias("run"))
        return found.filter(~rules.noise_text(F.col("run")))

    even = F.expr("substring(content, 1, length(content) - length(content) % 2)")
    as_bytes = F.make_valid_utf8(F.col("content").cast("string"))
    return runs(as_bytes, "utf8").unionByName(runs(F.decode(even, "UTF-16LE"), "utf16le")).distinct()


def list_filter(df: DataFrame, fields: list[str], q: str, **equal) -> DataFrame:
    for k, v in equal.items():
        df = df.filter(F.col(k) == v)
    return df.filter(F.lower(F.concat_ws(" ", *fields)).contains(q.lower()))


def match_source(df: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.select(F.lower("path").alias("k"), F.col("source")).dropDuplicates(["k"])
    return df.join(m, F.lower("path") == F.col("k"), "left").drop("k")


def merge_sections(sections: DataFrame, messages: DataFrame) -> DataFrame:
    """(section, citation) -> section, citations (valid ones, distinct, sorted), dropped (number)."""
    ok = messages.select(scalars.citation("message", F.col("message_uid")).alias("citation"), F.lit(True).alias("ok"))
    j = sections.distinct().join(ok, "citation", "left")
    return j.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("citation")))), " ").alias("citations"), F.count_if(F.col("ok").isNull()).alias("dropped"))
