"""Column expressions of the message store: types, payloads, identity, time, text measures."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the message format.
TYPE_LABELS = {1: "text", 3: "image", 34: "voice", 42: "card", 43: "video", 47: "sticker", 48: "location", 49: "app", 50: "voip", 10000: "system", 10002: "system"}
MEDIA_TYPES = (3, 34, 43, 47, 48, 50)
MEDIA_TEXT = {3: "[图片]", 34: "[语音]", 43: "[视频]", 47: "[表情]", 48: "[位置]", 50: "[通话]"}
EMPTY_APP, CARD, SYSTEM, EMPTY_SYSTEM = "[链接/应用消息]", "[名片]", "[系统] ", "[系统消息]"
GROUP_PREFIX = r"^([0-9A-Za-z_@.-]+):\n"
#: Java's \s knows ASCII white space only; text may hold no-break and ideographic spaces too.
SPACE = r"[\s   -     　﻿]"
SYSTEM_LIMIT = 300


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f names it: expressions inside of lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def trim_all(c: Column) -> Column:
    """Texts that neither begin nor end with white space are not searched for it."""
    return F.when(F.substring(c, 1, 1).rlike(SPACE) | F.substring(c, -1, 1).rlike(SPACE), F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")).otherwise(c)


def lookup(c: Column, values: Mapping, default: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[c.cast("long")], default)


def norm_type(raw_type: Column) -> Column:
    """The low 32 bits, also of negative and 64-bit raw types."""
    return raw_type.cast("long").bitwiseAND(F.lit(4294967295).cast("long"))


def type_label(kind: Column) -> Column:
    return lookup(kind, TYPE_LABELS, F.concat(F.lit("type_"), kind.cast("string")))


def split_prefix(text: Column, is_group: Column) -> Column:
    """struct(sender_prefix, body): a leading `id:` line, in groups only."""
    found = is_group & text.rlike(GROUP_PREFIX)
    return F.struct(
        F.when(found, F.regexp_extract(text, GROUP_PREFIX, 1)).otherwise("").alias("sender_prefix"),
        F.when(found, F.regexp_replace(text, GROUP_PREFIX, "")).otherwise(text).alias("body"),
    )


def xml_tag(body: Column, tag: str) -> Column:
    """Text of the first such element with its CDATA wrappers taken off; empty if absent. Input need not be well-formed."""
    inner = F.regexp_extract(body, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return trim_all(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def xml_attr(body: Column, name: str) -> Column:
    return trim_all(F.regexp_extract(body, rf"(?is)\s{name}\s*=\s*([\"'])(.*?)\1", 2))


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def locator_evidence(body: Column) -> Column:
    """map of the present ones of four file ids and three CDN references."""
    either = lambda n: _first(xml_tag(body, n), xml_attr(body, n))
    fields = {
        "attach_id": either("attachid"), "file_key": either("filekey"), "md5": either("md5"), "new_md5": either("newmd5"), "attachment": either("cdnattachurl"),
        "original": _first(xml_attr(body, "cdnmidimgurl"), xml_attr(body, "cdnvideourl"), xml_attr(body, "cdnurl")), "thumbnail": _first(xml_attr(body, "cdnthumburl")),
    }
    return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def content_kind(kind: Column, body: Column) -> Column:
    return (
        F.when(kind == 1, "text").when((kind == 49) | body.contains("<appmsg"), "app").when(kind.isin(*MEDIA_TYPES), "media")
        .when(kind == 42, "app").when(kind.isin(10000, 10002), "system").otherwise("unknown")
    )


def app_text(body: Column) -> Column:
    title, about = xml_tag(body, "title"), xml_tag(body, "des")
    ext, app = xml_tag(body, "fileext"), F.coalesce(_first(xml_tag(body, "sourcedisplayname"), xml_tag(body, "appname")), F.lit(""))
    parts = [
        F.nullif(title, F.lit("")), F.when((about != "") & (about != title), about), F.when(ext != "", F.concat(F.lit("[文件 ."), ext, F.lit("]"))),
        F.nullif(xml_tag(body, "url"), F.lit("")), F.when(app != "", F.concat(F.lit("("), app, F.lit(")"))),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" — ", *parts), F.lit("")), F.lit(EMPTY_APP))


def media_text(kind: Column) -> Column:
    return lookup(kind, MEDIA_TEXT, F.concat(F.lit("["), type_label(kind), F.lit("]")))


def card_text(body: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.lit(CARD), xml_tag(body, "nickname")))


def system_text(body: Column) -> Column:
    """Tags taken off; prefix and text together hold at most SYSTEM_LIMIT code points."""
    plain = trim_all(F.regexp_replace(body, "<[^>]+>", ""))
    return F.when(plain != "", F.concat(F.lit(SYSTEM), F.substring(plain, 1, SYSTEM_LIMIT - len(SYSTEM)))).otherwise(EMPTY_SYSTEM)


def content_text(kind: Column, body: Column) -> Column:
    """The text a message shows, by its kind."""
    what = content_kind(kind, body)
    return (
        F.when(what == "text", trim_all(body)).when((kind == 42) & ~body.contains("<appmsg"), card_text(body)).when(what == "app", app_text(body))
        .when(what == "media", media_text(kind)).when(what == "system", system_text(body)).otherwise(F.concat(F.lit("["), type_label(kind), F.lit("]")))
    )


def pick_payload(content: Column, decoded: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), decoded)


def archive_day(epoch: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd")


def archive_ts(epoch: Column, zone: str) -> Column:
    """yyyy-MM-dd HH:mm:ss +hh:mm, with the zone's offset at that instant."""
    utc = F.timestamp_seconds(epoch)
    local = F.from_utc_timestamp(utc, zone)
    off = F.unix_timestamp(local) - F.unix_timestamp(utc)
    half = F.format_string("%s%02d:%02d", F.when(off < 0, "-").otherwise("+"), F.floor(F.abs(off) / 3600).cast("int"), F.floor(F.abs(off) % 3600 / 60).cast("int"))
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), half)


def person_id(owner: Column, username: Column) -> Column:
    return F.concat(F.lit("wxp:"), F.sha2(F.concat(F.trim(owner), F.char(F.lit(0)), F.trim(username)), 256))


def clean_server_id(c: Column) -> Column:
    """Null where the id is blank or 0, which both mean there is none."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("0"))


def message_uid(conv_id: Column, server_id: Column, source_db: Column, source_table: Column, local_id: Column) -> Column:
    sid = clean_server_id(server_id)
    own = F.concat_ws(":", source_db, source_table, local_id.cast("string"))
    return F.sha2(F.concat_ws("\n", conv_id, F.when(sid.isNotNull(), F.concat(F.lit("s:"), sid)).otherwise(F.concat(F.lit("l:"), own))), 256)


def msg_table(username: Column) -> Column:
    return F.concat(F.lit("Msg_"), F.md5(username))


def conv_id(owner: Column, username: Column) -> Column:
    return F.concat_ws(":", F.lit("wx"), owner, username)


def resolve_sender(is_group: Column, mapped: Column, prefix: Column, owner: Column, peer: Column, is_own: Column) -> Column:
    """struct(sender, sender_source, sender_audit): the id map first, then a group's prefix, then a private chat's two sides; never a guess."""
    m, p = blank_to_null(mapped), blank_to_null(prefix)
    source = F.when(m.isNotNull(), "id_map").when(is_group & p.isNotNull(), "group_prefix").when(~is_group & is_own, "private_self").when(~is_group & is_own.isNotNull(), "private_peer").otherwise("unknown")
    sender = F.when(source == "id_map", m).when(source == "group_prefix", p).when(source == "private_self", owner).when(source == "private_peer", peer)
    audit = F.when(is_group & m.isNotNull() & p.isNotNull() & (m != p), "prefix_mismatch").when(source == "unknown", "sender_unresolved")
    return F.struct(sender.alias("sender"), source.alias("sender_source"), audit.alias("sender_audit"))


def fingerprint(*cs: Column) -> Column:
    """sha256 over columns in which null, empty and shifted values differ."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cs])), 256)


def one_spaced(c: Column) -> Column:
    """Runs of SPACE as one space. Texts without white space beyond ASCII, told by a class of four ranges that holds all of it, take single_spaced()."""
    ascii_only = (F.octet_length(c) == F.length(c)) | ~c.rlike(r"[\x{A0}\x{1680}\x{2000}-\x{3000}\x{FEFF}]")
    return F.when(ascii_only, single_spaced(c)).otherwise(F.regexp_replace(c, f"{SPACE}+", " "))


def clean_text(c: Column) -> Column:
    """One line without NULs, single-spaced, four entities decoded, trimmed: no white space but plain spaces is left to trim."""
    def decoded(t: Column) -> Column:
        plain = t
        for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
            plain = F.regexp_replace(plain, f"(?i)&{name};", char)
        return F.trim(F.when(t.contains("&"), plain).otherwise(t))

    return let(let(F.replace(c, F.lit("\u0000"), F.lit("")), one_spaced), decoded)


def strip_html(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h\d)>", "\n")
    return F.when(c.contains("<"), F.regexp_replace(t, "<[^>]+>", " ")).otherwise(c)


def single_spaced(c: Column) -> Column:
    """Runs of ASCII white space as one space; single spaces are left alone, which is most of the work saved."""
    return F.regexp_replace(c, r"[\t\n\x0B\f\r]\s*| \s+", " ")


def norm_time(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of the usual written forms; other text comes back with its marks unified."""
    p = r"(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"

    def written(v: Column) -> Column:
        g = [F.regexp_extract(v, p, i) for i in range(1, 7)]
        day = F.concat_ws("-", g[0], F.lpad(g[1], 2, "0"), F.lpad(g[2], 2, "0"))
        clock = F.concat_ws(":", F.lpad(g[3], 2, "0"), g[4], let(g[5], lambda s: F.when(s == "", "00").otherwise(s)))
        return F.when(v.rlike(p), F.concat_ws(" ", day, clock)).otherwise(v)

    return let(F.trim(F.translate(F.regexp_replace(c, "日", ""), "年月/T：", "--- :")), written)


def ngrams(c: Column) -> Column:
    """Two- and three-grams of Han runs, then lower-cased Latin identifiers; distinct, in order."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{IsHan}+"), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        last = F.length(run) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    han = F.when(may_be_heavy(c), F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3))))).otherwise(F.array().cast("array<string>"))
    # ASCII texts are lower-cased whole; in others, letters beyond ASCII could become ASCII ones, so words are, each once.
    words = F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_:@.-]+"), F.lit(0)))
    latin = F.when(F.octet_length(c) == F.length(c), F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_:@.-]+"), F.lit(0))).otherwise(F.transform(words, lambda w: F.lower(w)))
    return F.array_distinct(F.concat(han, latin))


# The code points of the Unicode property Extended_Pictographic.
PICTOGRAPHS = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}"
    r"\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}"
    r"\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}"
    r"\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}"
    r"\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}"
    r"\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}"
    r"\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}"
)
HEAVY = r"\p{IsHan}" + PICTOGRAPHS
#: A class that holds all of HEAVY and is cheap to look for; most Latin texts have none of it.
MAY_BE_HEAVY = r"[\x{A9}\x{AE}\x{203C}-\x{10FFFF}]"


def may_be_heavy(c: Column) -> Column:
    return (F.octet_length(c) != F.length(c)) & c.rlike(MAY_BE_HEAVY)


def _weighed(c: Column, heavy: str, light: float) -> Column:
    n = F.when(may_be_heavy(c), F.length(F.regexp_replace(c, f"[^{heavy}]", ""))).otherwise(0)
    return F.ceil(n + (F.length(c) - n) * F.lit(light)).cast("long")


def point_weight(c: Column) -> Column:
    """The weight of one code point: 1 for a Han character or a pictograph, else a quarter."""
    return F.when(c.rlike(f"[{HEAVY}]"), 1.0).otherwise(0.25)


def search_tokens(c: Column) -> Column:
    """A Han character or a pictograph counts 1, anything else a quarter."""
    return _weighed(c, HEAVY, 0.25)


#: Stand for the further quarters of a heavy character while a text is cut; a text that holds the mark itself is cut character by character.
MARK = "\uffff"


def split_text(c: Column, most: int) -> Column:
    """Pieces of at most `most` search tokens, cut between code points; nothing for an empty text.

    A text is cut into runs of 4 * most light characters; where there may be heavy ones, each is followed by three marks, and no piece ends before a mark.
    """
    if most < 1:
        return _split_each(c, most)
    light = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{4 * most}}}"), F.lit(0))
    marked = F.regexp_replace(c, f"([{HEAVY}])", f"$1{MARK * 3}")
    runs = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{4 * most}}}(?!{MARK})"), F.lit(0))
    mixed = F.when(c.contains(MARK), _split_each(c, most)).otherwise(F.transform(runs, lambda p: F.replace(p, F.lit(MARK), F.lit(""))))
    return F.when(may_be_heavy(c), mixed).otherwise(light)


def _split_each(c: Column, most: int) -> Column:
    """split_text() character by character."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0.0).alias("w"))

    def step(acc: Column, ch: Column) -> Column:
        n = point_weight(ch)
        full = (acc["cur"] != "") & (F.ceil(acc["w"] + n) > most)
        done = F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, ch).otherwise(F.concat(acc["cur"], ch)).alias("cur"), F.when(full, n).otherwise(acc["w"] + n).alias("w"))

    return F.aggregate(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), start, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def prompt_tokens(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"[^　-〿぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯]", ""))
    return F.ceil(n + (F.length(c) - n) / F.lit(3.5)).cast("long")


def lookup_hashes(c: Column) -> Column:
    """Lower-case 32-digit hex runs that stand alone."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])"), F.lit(0)), lambda h: F.lower(h)))


def evidence_signature(evidence: Column) -> Column:
    """sha256 over sorted, distinct, lower-cased evidence strings."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(F.transform(F.filter(evidence, lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))))), 256)


def asset_id(conv: Column, evidence: Column) -> Column:
    return F.concat(F.lit("asset:"), F.sha2(F.concat_ws("\n", conv, evidence_signature(evidence)), 256))


def is_public_url(c: Column) -> Column:
    """Scheme http(s), no credentials, no local or private host; names are not resolved."""
    host = F.lower(F.regexp_extract(c, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    credentials = c.rlike(r"^(?i:https?)://[^/?#]*@")
    private = host.rlike(r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|2[3-5]\d)\.")
    ipv6 = host.rlike(r"^\[(?:::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*)\]$")
    local = host.isin("localhost", "") | host.rlike(r"\.(?:localhost|local|internal|lan|home)$")
    return F.coalesce(c.rlike("^(?i:https?)://") & ~credentials & ~private & ~ipv6 & ~local, F.lit(False))


#: Leading bytes, as hex.
MAGIC = (("jpeg", "^FFD8FF"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("webp", "^52494646.{8}57454250"), ("wxgf", "^77786766"), ("silk", "^(?:02)?232153494C4B"), ("amr", "^2321414D52"))


def media_magic(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 16)), F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def citation(kind: str, ident: Column) -> Column:
    return F.concat(F.lit({"message": "[消息:", "file": "[文件:"}[kind]), ident, F.lit("]"))
