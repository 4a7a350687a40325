"""Web addresses in text, in the canonical form that browsers give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.scalars import let

# What an address in a text consists of, and the marks cut off its end.
FOUND = "(?iu)https?://[^\\s<>\"'`，。！？；：、（）【】《》「」『』]+"
TRAILING = r"[.,!?;:)\]}]+$"
# The characters that the URL standard percent-encodes in a path, a query and a fragment, beside controls and what is not ASCII.
IN_PATH, IN_QUERY, IN_FRAGMENT, IN_USER = r' "#<>?^`{}', ' "#<>\'', ' "<>`', r' "#<>?^`{}/:;=@|\[\]\\'
FORBIDDEN_HOST = r"[\x00-\x20\x7F#/:<>?@\[\\\]^|%]"


def encoded(c: Column, more: str) -> Column:
    """c with controls, what is not ASCII and the characters of more percent-encoded, byte by byte."""
    special = f"[\\x{{0}}-\\x{{1F}}\\x{{7F}}-\\x{{10FFFF}}{more}]"
    one = lambda p: F.when(p.rlike(special), F.regexp_replace(F.hex(F.encode(p, "utf-8")), "(..)", "%$1")).otherwise(p)
    return let(c, lambda s: F.when(s.rlike(special), F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(s))


def _number(part: Column) -> Column:
    """The value of a part of an IPv4 host: decimal, octal after 0, hexadecimal after 0x; null if it is none."""
    return (
        F.when(part.rlike("^0x[0-9a-f]{0,8}$"), F.coalesce(F.conv(F.nullif(F.substring(part, 3, 8), F.lit("")), 16, 10).cast("long"), F.lit(0)))
        .when(part.rlike("^0[0-7]{1,11}$"), F.conv(part, 8, 10).cast("long")).when(part.rlike("^[0-9]{1,10}$") & ~part.rlike("^0[0-9]"), part.cast("long"))
    )


def _ipv4(host: Column) -> Column:
    """A dotted quad; null if the host ends in a number but is no address."""
    def dotted(values: Column) -> Column:
        n = F.size(values)
        last = F.element_at(values, -1)
        high = F.slice(values, 1, n - 1)
        room = F.pow(F.lit(256), 5 - n).cast("long")
        valid = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(high, lambda v: v <= 255) & (last < room)
        byte = lambda i: F.when(F.lit(i) < n - 1, F.get(values, F.lit(i))).otherwise(F.shiftright(last, 8 * (3 - i)).bitwiseAND(255))
        return F.when(valid, F.concat_ws(".", *[byte(i).cast("string") for i in range(4)]))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _number), dotted)


def _host(host: Column) -> Column:
    """A host in lower case and ASCII; null for what cannot be one."""
    plain = lambda h: F.when(h.contains("%"), F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B")))).otherwise(h)
    ascii_ = lambda p: F.when(p.rlike(r"[^\x00-\x7F]"), F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), p)).otherwise(p)

    def checked(low: Column) -> Column:
        numeric = low.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
        return F.when(low.rlike(r"^\[[0-9a-f:.]+\]$"), low).when(low.isNull() | (low == "") | low.rlike(FORBIDDEN_HOST), None).when(numeric, _ipv4(low)).otherwise(low)

    return let(let(host, plain), lambda p: let(F.lower(ascii_(p)), checked))


def _path(path: Column) -> Column:
    """A path from its first slash on, without dot segments; a folder's keeps its last slash."""
    dot = lambda s: F.lower(F.regexp_replace(s, "(?i)%2e", "."))
    step = lambda done, s: let(dot(s), lambda d: (
        F.when(d == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(d == ".", done).otherwise(F.concat(done, F.array(s)))
    ))

    def joined(parts: Column) -> Column:
        folder = dot(F.element_at(parts, -1)).isin(".", "..")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), "/").otherwise("")))

    return let(F.slice(F.split(path, "/"), 2, F.length(path) + 1), joined)


def canonical_url(c: Column) -> Column:
    """The canonical form of an http(s) address, null for what is none: scheme and host in lower case and ASCII, IPv4 as a dotted quad, no default port,
    no dot segments, a path of / at least, and what has to be percent-encoded encoded. IPv6 addresses keep their spelling but for case."""
    clean = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "[\t\n\r]", "")
    names = ("scheme", "authority", "path", "query", "fragment")

    def cut(s: Column) -> Column:
        return F.struct(*[F.regexp_extract(s, r"^(?i:(https?):[/\\]*)([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i).alias(n) for i, n in enumerate(names, 1)])

    def located(a: Column) -> Column:
        place = F.regexp_replace(a["authority"], "^.*@", "")
        return F.struct(
            F.lower(a["scheme"]).alias("scheme"), F.regexp_extract(a["authority"], r"^(.*)@", 1).alias("user"), F.regexp_replace(F.regexp_extract(place, r":([0-9]*)$", 1), "^0+(?=.)", "").alias("port"),
            _host(F.regexp_replace(place, ":[0-9]*$", "")).alias("host"), a["path"].alias("path"), F.coalesce(a["query"], F.lit("")).alias("query"), F.coalesce(a["fragment"], F.lit("")).alias("fragment"),
        )

    def whole(a: Column) -> Column:
        scheme, user, port, path = (a[n] for n in ("scheme", "user", "port", "path"))
        login = F.regexp_extract(user, "^([^:]*)", 1)
        password = F.when(user.contains(":"), F.regexp_extract(user, "^[^:]*:(.*)$", 1)).otherwise("")
        usual = F.when(scheme == "http", "80").otherwise("443")
        shown = F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))
        account = F.when((login == "") & (password == ""), "").otherwise(F.concat(encoded(login, IN_USER), F.when(password == "", "").otherwise(F.concat(F.lit(":"), encoded(password, IN_USER))), F.lit("@")))
        tidy = encoded(_path(F.concat(F.when(path.rlike(r"^[/\\]"), "").otherwise("/"), F.replace(path, F.lit("\\"), F.lit("/")))), IN_PATH)
        fits = (scheme != "") & a["host"].isNotNull() & (F.length(port) <= 5) & (F.coalesce(F.nullif(port, F.lit("")), F.lit("0")).cast("long") <= 65_535)
        return F.when(fits, F.concat(scheme, F.lit("://"), account, a["host"], shown, tidy, encoded(a["query"], IN_QUERY), encoded(a["fragment"], IN_FRAGMENT)))

    return let(let(let(clean, cut), located), whole)


def extract_urls(text: Column, xml: Column | None = None) -> Column:
    """The addresses of a text, then those of a message's XML with its ampersands decoded: canonical, distinct, in order. Null texts have none."""
    sources = [text] if xml is None else [text, F.regexp_replace(xml, "(?i)&amp;|&#38;|&#x26;", "&")]
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(FOUND), F.lit(0)) for s in sources]))
    return F.array_distinct(F.array_compact(F.transform(found, lambda u: canonical_url(F.regexp_replace(u, TRAILING, "")))))
