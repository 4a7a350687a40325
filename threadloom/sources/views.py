"""The shared tables read as a message archive, and readers of archive exports."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import rules, scalars
from threadloom.sources.exports import NO_CONTENT, NO_SENDER, export_lines, read_csv_exports, read_json_exports  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Whole seconds; zone-less timestamps count as UTC, which the session zone must be."""
    return F.unix_timestamp(ts.cast("timestamp"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without time: conv_id, canonical_seq, sender, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), (F.row_number().over(w) - 1).cast("long").alias("canonical_seq"), F.col("role").alias("sender"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, not yet in canonical order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("conv_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_uid"), epoch(F.col("ts")).alias("occurred_at_epoch_s"),
        F.col("event_id").alias("source_sort_seq"), F.concat(F.lit("message_"), (F.col("event_id") % 3).cast("string"), F.lit(".db")).alias("source_db"),
        F.when(F.col("event_id") % 7 == 0, "biz").otherwise("regular").alias("source_adapter"), F.col("event_id").alias("local_id"),
        F.when(F.col("event_id") % 5 == 0, "0").otherwise(F.col("event_id").cast("string")).alias("server_id"), (F.col("event_id") % 2 * F.lit(4294967296) + 1).alias("raw_type"),
        (F.col("event_id") % 11).alias("real_sender_id"), F.col("event_type").alias("sender"), F.col("props").alias("text"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over shards, every tenth of them once more in another shard."""
    e = events(spark, sf_dir)
    again = e.filter(F.col("local_id") % 10 == 3).withColumns({"source_db": F.lit("biz_message_0.db"), "source_adapter": F.lit("biz"), "source_sort_seq": F.col("source_sort_seq") + 1})
    return e.unionByName(again)


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_db, rowid) -> user_name; ids mean another person in every shard, and some are missing."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("message_"), (F.col("c_custkey") % 3).cast("string"), F.lit(".db")).alias("source_db"), F.floor(F.col("c_custkey") / 3).alias("rowid"), F.col("c_name").alias("user_name"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contacts, with blank names in places."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("username"), F.when(k % 4 == 0, F.concat(F.lit("remark "), F.col("c_mktsegment"))).otherwise(" ").alias("remark"),
        F.when(k % 3 == 0, F.concat(F.lit("nick "), k.cast("string"))).otherwise("").alias("nick"), F.when(k % 5 == 0, F.lit("alias")).alias("alias"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, name, ext, size, modified, sha256."""
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "pdf", "py", "png", "zip", "dat")]), (d % 7 + 1).cast("int"))
    name = F.concat(F.lit("report"), (d % 50).cast("string"), F.when(d % 3 == 0, F.concat(F.lit("("), (d % 4).cast("string"), F.lit(")"))).otherwise(""), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(
        d.alias("file_id"), F.concat_ws("/", F.lit("/Data"), "source", "lang", name).alias("path"), name.alias("name"), F.concat(F.lit("."), ext).alias("ext"),
        F.col("n_chars").cast("long").alias("size"), (F.lit(1700000000) + d * 3600).alias("modified"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("root"), "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search chunk per pair of turns."""
    t = turns(spark, sf_dir).withColumn("pair", F.floor(F.col("canonical_seq") / 2))
    g = t.groupBy("conv_id", "pair").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("canonical_seq", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("canonical_seq").alias("first_sequence"), F.max("canonical_seq").alias("last_sequence"), F.array_sort(F.collect_set("sender")).alias("sender_ids"),
    )
    return g.select(F.concat_ws("-", "conv_id", F.col("pair").cast("string")).alias("chunk_id"), "conv_id", "first_sequence", "last_sequence", (F.col("last_sequence") * 60).alias("end_time"), "sender_ids", "text")


def han_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks(), those of every fifth conversation with six letters written in Han."""
    han = F.when(F.col("conv_id").cast("long") % 5 == 0, F.translate("text", "etaoin", "深度学习没有")).otherwise(F.col("text"))
    return chunks(spark, sf_dir).withColumn("text", han)


# Readers.

REQUIRED = ("local_id", "server_id", "local_type", "sort_seq", "real_sender_id", "create_time", "message_content")


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shard tables stored as Parquet, one file or folder each: their columns as one table, with its file as source_db.

    A table without compress_content gets it as null; order is by sort_seq and local_id only where it is asked for.
    """
    out = None
    for p in paths:
        one = spark.read.parquet(p).withColumn("source_db", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if "compress_content" not in out.columns:
        out = out.withColumn("compress_content", F.lit(None).cast("binary"))
    return out.withColumns({"server_id": F.col("server_id").cast("string"), "source_domain": source_domain(F.col("source_db"))})


def source_domain(name: Column) -> Column:
    """regular, biz, media, resource or unknown, by file name."""
    return (
        F.when(name.rlike(r"(?i)^message_\d+\.db$"), "regular").when(name.rlike(r"(?i)^biz_message_\d+\.db$"), "biz")
        .when(name.rlike(r"(?i)^(media_\d+|hardlink)\.db$"), "media").when(name.rlike(r"(?i)^message_resource\.db$"), "resource").otherwise("unknown")
    )


def schema_gate(columns: DataFrame) -> DataFrame:
    """(source_db, source_table, column) rows -> one row per table with its missing required columns and a reason to exclude it."""
    need = F.array(*[F.lit(c) for c in REQUIRED])
    g = columns.groupBy("source_db", "source_table").agg(F.collect_set(F.lower("column")).alias("has"))
    lacks = F.array_join(F.array_sort(F.array_except(need, "has")), ",")
    return g.select("source_db", "source_table", lacks.alias("missing"), F.when(lacks != "", "missing_columns").alias("exclusion_reason"))


def display_name(remark: Column, nick: Column, alias: Column, username: Column) -> Column:
    return F.coalesce(*[scalars.blank_to_null(c) for c in (remark, nick, alias)], username)


def read_contacts(contacts_: DataFrame, rooms: DataFrame) -> DataFrame:
    """username, display, is_group: contacts, and rooms that no contact names."""
    c = contacts_.select("username", display_name(F.col("remark"), F.col("nick"), F.col("alias"), F.col("username")).alias("display"))
    extra = rooms.select("username").distinct().join(c, "username", "left_anti").withColumn("display", F.col("username"))
    return c.unionByName(extra).withColumn("is_group", F.col("username").endswith("@chatroom"))


def resolve_owner(contacts_: DataFrame, fragment: str) -> str:
    """The one non-group username that contains the fragment; anything else is an error."""
    got = contacts_.filter(F.col("username").contains(fragment) & ~F.col("username").endswith("@chatroom")).select("username").distinct().limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"{len(got)} accounts match {fragment!r}; exactly one must")
    return got[0]["username"]


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """inventory_rows of the files below path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return inventory_rows(f.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime"), path)


def inventory_rows(found: DataFrame, root: str) -> DataFrame:
    """(path, length, modificationTime) of files below root -> path, root, relative, name, ext, size, modified; one row a path."""
    top = root.rstrip("/")
    relative = F.when(F.col("path").startswith(top + "/"), F.substring("path", len(top) + 2, 1 << 30)).otherwise(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return found.dropDuplicates(["path"]).select(
        "path", F.lit(top).alias("root"), relative.alias("relative"), name.alias("name"), rules.extension(F.col("path")).alias("ext"),
        F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"),
    )


def read_sessions(rows: DataFrame | None) -> DataFrame | None:
    """username, last_time, summary (of the latest row; of equals the greatest): one row a username. None where there is no such table."""
    return None if rows is None else rows.groupBy("username").agg(F.max("last_time").alias("last_time"), F.max_by("summary", F.struct("last_time", "summary")).alias("summary"))


def deferred_inventory(rows: DataFrame, parsed: tuple[str, ...] = ("regular", "biz")) -> DataFrame:
    """source_db, discovered, reason: rows of the domains that are counted but not parsed."""
    later = rows.filter(~source_domain(F.col("source_db")).isin(*parsed))
    return later.groupBy("source_db").agg(F.count("*").alias("discovered")).withColumn("reason", F.lit("deferred_domain"))


# What the path of an export says, and how large and how many they may be.
EXPORT_NAME = r"(?i)qq|(^|[^a-z])chat([^a-z]|$)|message|messages|msg|conversation|dialog|聊天|消息|群聊|好友"
MAX_EXPORT_BYTES, MAX_EXPORT_FILES = 50 * 1024 * 1024, 5000


def export_candidates(files_: DataFrame, name_hint: str = EXPORT_NAME, most: int = MAX_EXPORT_FILES) -> DataFrame:
    """Files that may be chat exports, by extension, name, size and folder; at most `most`, by path (count_export_candidates() tells how many there are)."""
    ok = F.col("ext").rlike(r"(?i)^\.(txt|md|csv|json|html?)$") & F.col("path").rlike(name_hint) & F.col("size").between(1, MAX_EXPORT_BYTES)
    skip = F.col("path").rlike(r"(?i)/(node_modules|\.git|dist|archive|cache|logs?)/")
    return files_.filter(ok & ~skip).orderBy("path").limit(most)


def count_export_candidates(files_: DataFrame, name_hint: str = EXPORT_NAME, most: int = MAX_EXPORT_FILES) -> DataFrame:
    """One row: candidates, and how many of them export_candidates() leaves unread."""
    n = export_candidates(files_, name_hint, 2**31 - 1).agg(F.count("*").alias("candidates"))
    return n.withColumn("unread", F.greatest(F.col("candidates") - most, F.lit(0)))


# How a line opens a message.
DATE, CLOCK = r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?", r"\d{1,2}[:：]\d{2}(?::\d{2})?"
LINES = (
    (rf"^\s*\[?({DATE}\s+{CLOCK})\]?\s+(.{{1,60}}?)[：:]\s*(.+)$", r"1", 2, 3),
    (rf"^\s*({DATE})\s+({CLOCK})\s+(.{{1,60}}?)[：:]\s*(.+)$", r"1 2", 3, 4),
    (rf"^\s*(.{{1,60}}?)\s+({DATE}\s+{CLOCK})\s*[：:]\s*(.+)$", r"2", 1, 3),
)


def read_text_exports(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) -> path, seq, time, sender, content: a line that opens a message, in one of three forms, and the lines that go on with it.

    Lines that open with header words, or hold nothing but a placeholder, are no messages; lines that start with a year go on with none.
    Contents are whole, however long.
    """
    line = F.col("line")
    # Which form a line has is told once; each field is then taken by that form's pattern alone.
    form = F.when(line.rlike(LINES[0][0]), 0).when(line.rlike(LINES[1][0]), 1).when(line.rlike(LINES[2][0]), 2)
    formed = lines.select("path", "line_no", F.trim("line").alias("line")).select("*", form.alias("form"))

    def part(c: Column, pattern: str, groups) -> Column:
        return F.concat_ws(" ", *[F.regexp_extract(c, pattern, int(g)) for g in str(groups).split()])

    def first(at: int) -> Column:
        return F.coalesce(*[F.when(F.col("form") == i, part(line, x[0], x[at])) for i, x in enumerate(LINES)])

    sender = F.regexp_replace(scalars.clean_text(first(2)), "[：:]+$", "")
    read = formed.select("path", "line_no", line.alias("line"), first(1).alias("time"), sender.alias("sender"), scalars.clean_text(first(3)).alias("body"))
    opens = F.col("body").isNotNull()
    hit = opens & (F.col("sender") != "") & ~F.col("sender").rlike(NO_SENDER) & (F.length("body") >= 2) & ~F.col("body").rlike(NO_CONTENT)
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = read.withColumns({"hit": F.coalesce(hit, F.lit(False)), "opens": opens}).withColumn("seq", F.count(F.when(F.col("hit"), 1)).over(upto))
    goes_on = ~F.col("opens") & (F.col("line") != "") & ~F.col("line").rlike(r"^\d{4}[-/.年]")
    g = marked.filter((F.col("seq") > 0) & (F.col("hit") | goes_on)).groupBy("path", "seq").agg(
        F.max(F.when(F.col("hit"), scalars.norm_time(F.col("time")))).alias("time"), F.max(F.when(F.col("hit"), F.col("sender"))).alias("sender"),
        F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("hit"), F.col("body")).otherwise(F.col("line")).alias("t")))).alias("parts"),
    )
    text = scalars.clean_text(F.array_join(F.transform("parts", lambda x: x["t"]), " "))
    return g.select("path", "seq", "time", "sender", text.alias("content"))


def _meta(html: Column, name: str) -> Column:
    """Content of the first <meta> with that property or name, whichever attribute comes first."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*([\"'])(.*?)\1", 2)), F.lit(""))


ENTITIES = {"quot": '"', "#39": "'", "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "amp": "&"}


def decode_entities(c: Column, names: Collection[str] = tuple(ENTITIES)) -> Column:
    """c with the named entities decoded, &amp; last; only &amp; in lower case if it is the only one."""
    if tuple(names) == ("amp",):
        return F.replace(c, F.lit("&amp;"), F.lit("&"))
    for name, char in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i)&{name};", char) if name in names else c
    return c


def page_metadata(pages: DataFrame, entities: Collection[str] = tuple(ENTITIES)) -> DataFrame:
    """page_id, title (180 at most: 80), description (180), site (40): Open Graph first, then Twitter, then plain tags; these entities are decoded."""
    h = F.col("html")
    plain = F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    neat = lambda c, n: F.substring(F.trim(F.regexp_replace(decode_entities(c, entities), r"\s+", " ")), 1, n)
    title, about = F.coalesce(_meta(h, "og:title"), _meta(h, "twitter:title"), plain), F.coalesce(_meta(h, "og:description"), _meta(h, "twitter:description"), _meta(h, "description"))
    site = F.coalesce(_meta(h, "og:site_name"), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return pages.select(
        "page_id", F.coalesce(neat(title, 80), F.lit("")).alias("title"), F.coalesce(neat(about, 180), F.lit("")).alias("description"),
        F.coalesce(neat(site, 40), F.lit("")).alias("site"), page_icon(h, F.col("url")).alias("icon"),
    )


def page_icon(html: Column, url: Column) -> Column:
    """Address of the first <link> whose rel names an icon, made absolute by the page's address; "" if it is no http one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    value = lambda t, name: F.regexp_extract(t, rf"(?is)(?:^|\s){name}\s*=\s*([\"'])(.*?)\1", 2)
    icons = F.filter(tags, lambda t: value(t, "rel").rlike(r"(?i)(?:^|\s)icon(?:\s|$)"))
    href = F.trim(value(F.get(icons, F.lit(0)), "href"))
    origin, folder = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1), F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    base = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = (
        F.when(href.rlike("(?i)^https?://"), href).when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "").when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(base, href))
    )
    return F.coalesce(F.when(F.size(icons) > 0, full), F.lit(""))


def document_text(files_: DataFrame, max_chars: int = 24_000) -> DataFrame:
    """(path, content binary) -> path, text, truncated: strict UTF-8 (else null), tags of HTML taken off, cut at max_chars code points."""
    text = F.decode(F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content")), "UTF-8")
    shown = F.when(F.col("path").rlike(r"(?i)\.html?$"), scalars.clean_text(scalars.strip_html(text))).otherwise(text)
    return files_.select("path", F.substring(shown, 1, max_chars).alias("text"), F.coalesce(F.length(shown) > max_chars, F.lit(False)).alias("truncated"))


def check_budget(df: DataFrame, size: str, rows: int, largest: int, total: int) -> DataFrame:
    """df, once its row count, largest and total size are within their limits; an error otherwise."""
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.max(size), F.lit(0)).alias("top"), F.coalesce(F.sum(size), F.lit(0)).alias("sum")).first()
    for what, have, most in (("rows", got["n"], rows), ("largest value", got["top"], largest), ("total", got["sum"], total)):
        if have > most:
            raise ValueError(f"{what} {have} is over the limit of {most}")
    return df


def read_resources(info: DataFrame, detail: DataFrame) -> DataFrame:
    return info.join(detail, "message_id")


def adapt_legacy(messages: DataFrame) -> DataFrame:
    """Old layouts: a missing message_uid is made of the row and its content, and the order of (time, uid or seq, row) becomes canonical_seq."""
    have = F.col("message_uid") if "message_uid" in messages.columns else F.lit(None).cast("string")
    made = F.concat(F.lit("legacy:"), F.col("rowid").cast("string"), F.lit(":"), F.sha2(F.concat_ws("\u0000", "conv_id", F.col("occurred_at_epoch_s").cast("string"), F.coalesce("sender", F.lit("")), F.coalesce("text", F.lit(""))), 256))
    w = Window.partitionBy("conv_id").orderBy("occurred_at_epoch_s", F.coalesce(have, F.lit("")), "rowid")
    return messages.withColumn("canonical_seq", (F.row_number().over(w) - 1).cast("long")).withColumn("message_uid", F.coalesce(have, made))
