"""Chat exports as JSON, delimited text or HTML, read file by file; what exceeds a bound is marked, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import rules, scalars

# What sender and content that are none look like, how long they may be, and how many messages a file is read for.
NO_SENDER = "(?i)^(date|author|subject|refs|body|commit|merged|files?|index)$"
NO_CONTENT = r"(?i)^(图片|语音|表情|视频|文件|撤回了一条消息|\[图片]|\[表情]|\[语音]|\[视频])$"
MAX_SENDER, MAX_CONTENT, MAX_JSON, MAX_LINES, MAX_DEPTH = 80, 4000, 20_000, 9_999, 8
# Names of a JSON message's fields, and what the headers of delimited files hold.
JSON_FIELDS = {
    "content": ("content", "text", "message", "msg", "body", "html", "消息", "内容"),
    "sender": ("sender", "from", "name", "speaker", "nickName", "nickname", "user", "昵称", "发送者"),
    "time": ("time", "timestamp", "date", "createdAt", "createTime", "时间", "日期"),
}
HEADERS = {"time": "time|date|timestamp|时间|日期", "sender": "sender|from|name|speaker|昵称|发送者|发言人|用户", "content": "content|text|message|msg|body|内容|消息|正文"}


def clean_messages(rows: DataFrame, bound: int) -> DataFrame:
    """path, n (from 0, in order of at), sender, time, content, beyond: rows whose sender and content are a message; beyond marks those after the bound."""
    sender = F.substring(F.regexp_replace(scalars.clean_text(F.col("sender")), "[：:]+$", ""), 1, MAX_SENDER)
    time = scalars.norm_time(F.nullif("time", F.lit("")))
    real = lambda m: (m["sender"] != "") & ~m["sender"].rlike(NO_SENDER) & (F.length(m["content"]) >= 2) & ~m["content"].rlike(NO_CONTENT)
    # A filter on columns would be pushed below them and clean each text again for every condition.
    cleaned = F.array(F.struct(sender.alias("sender"), time.alias("time"), scalars.clean_text(F.col("content")).alias("content")))
    kept = rows.select("path", "at", F.inline(F.filter(cleaned, real)))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1  # a file is bounded by the candidate gate
    return kept.withColumn("n", nth).select("path", "n", "sender", "time", F.substring("content", 1, MAX_CONTENT).alias("content"), (F.col("n") >= bound).alias("beyond"))


def _first_field(names: tuple[str, ...]) -> Column:
    """The first of an object's named fields that is a string or a number, as a string."""
    def one(name: str) -> Column:
        path = f"$['{name}']"
        kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
        return F.when(kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("v", path, "string"))

    return F.coalesce(*map(one, names))


def read_json_exports(texts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(path, text) -> clean_messages() of every object, at a depth of at most `depth`, that has a content and a sender.

    Messages stand in the order of a walk from the top; the fields of one object are walked in order of their names.
    Files are parsed once and walked in one pass: at each depth a value that is a message is set aside, as a row without a value, before it is opened.
    A broken file is a row without a value and without a content, which is no message.
    """
    spark = texts.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = list(JSON_FIELDS)
    level = texts.select("path", F.try_parse_json("text").alias("v"), F.array().cast("array<int>").alias("at"), *[F.lit(None).cast("string").alias(k) for k in names])
    for d in range(depth + 1):
        # Arrays and single values have no named fields, so only objects give any.
        seen = level.select("path", "at", "v", *[F.when(F.col("v").isNotNull(), _first_field(JSON_FIELDS[k])).otherwise(F.col(k)).alias(k) for k in names])
        roles = F.when(F.col("v").isNull(), F.array(F.lit(True))).when((F.col("content") != "") & (F.col("sender") != ""), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        both = seen.select("*", F.explode(roles).alias("found"))
        if d == depth:
            return clean_messages(both.filter("found").select("path", "at", *names), MAX_JSON)
        both.createOrReplaceTempView("__export_level")
        kept = ", ".join(f"IF(found, {k}, NULL) AS {k}" for k in names)
        level = spark.sql(f"SELECT path, c.value AS v, IF(found, at, concat(at, array(c.pos))) AS at, {kept} FROM __export_level, LATERAL variant_explode_outer(IF(found, NULL, v)) AS c WHERE found OR c.value IS NOT NULL")
        spark.catalog.dropTempView("__export_level")


def read_csv_exports(texts: DataFrame) -> DataFrame:
    """(path, text) -> clean_messages() of delimited files, by tabs if the first line has one, else by commas; quotes mean nothing.

    Columns are told by what their headers hold, the first that fits; files without a sender's or a content's column give nothing.
    """
    lines = F.filter(F.split("text", "\r?\n"), lambda x: x != "")
    rows = texts.select("path", lines.alias("lines")).filter(F.size("lines") >= 2)
    cut = F.when(F.col("lines")[0].contains("\t"), "\t").otherwise(",")
    rows = rows.select("path", "lines", cut.alias("cut")).withColumn("heads", F.transform(F.split(F.col("lines")[0], F.col("cut")), lambda h: F.lower(scalars.clean_text(h))))

    def place(k: str) -> Column:
        hits = F.filter(F.transform("heads", lambda h, i: F.when(h.rlike(HEADERS[k]), i)), lambda i: i.isNotNull())
        return F.get(hits, F.lit(0))

    rows = rows.select("path", "cut", F.slice("lines", 2, F.size("lines")).alias("lines"), *[place(k).alias(f"i_{k}") for k in HEADERS]).filter("i_sender IS NOT NULL AND i_content IS NOT NULL")
    each = rows.select("path", *[f"i_{k}" for k in HEADERS], "cut", F.posexplode("lines").alias("at", "line")).withColumn("cells", F.split("line", F.col("cut")))
    return clean_messages(each.select("path", "at", *[F.coalesce(F.get("cells", F.col(f"i_{k}")), F.lit("")).alias(k) for k in HEADERS]), MAX_LINES)


def export_lines(texts: DataFrame) -> DataFrame:
    """(path, text) -> path, line_no, line of text exports; HTML files are stripped of their tags first."""
    plain = F.when(rules.extension(F.col("path")).rlike(r"^\.html?$"), scalars.strip_html(F.col("text"))).otherwise(F.col("text"))
    return texts.select("path", F.posexplode(F.split(plain, "\r?\n")).alias("line_no", "line"))
