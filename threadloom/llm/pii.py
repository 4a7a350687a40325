"""Personal data: pattern spans, and terms that the corpus shows to give them away.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key

KINDS = ("email", "ip", "card", "phone", "term")
#: kind -> (pattern, pattern that must be found before positions are worked out). The patterns match what the
#: plain ones match. Possessive repeats run in a loop, where Java's plain groups would use up the stack on long
#: runs; a match can start only where its first run starts or the last match ended, which keeps long runs linear.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", None),
}
TERM = r"\p{L}{3,}"
#: Code points of a tile. The context of a span is its own tile and the one on each side.
REACH = 160


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        two = 2 * x
        return total + F.when((n - i) % 2 == 1, F.when(two > 9, two - 9).otherwise(two)).otherwise(x)

    return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        small = lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255"))
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _sums_before(x: Column) -> Column:
    """For each entry of an array of int the sum of those before it; x is named often, so it should be a variable.

    A fold copies its list at every step. Blocks of about the cube root of the length keep those copies short:
    a million entries cost about a hundred copied entries each, ten thousand about twenty.
    """
    none = F.array().cast("array<int>")

    def fold(a: Column) -> Column:
        empty = F.struct(F.lit(0).alias("p"), none.alias("out"))
        add = lambda acc, v: F.struct((acc["p"] + v).alias("p"), F.concat(acc["out"], F.array(acc["p"])).alias("out"))
        return F.aggregate(a, empty, add, lambda acc: acc["out"])

    width = F.greatest(F.lit(8), F.ceil(F.cbrt(2.0 * F.size(x)))).cast("int")

    def by_blocks(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), w), lambda i: F.slice(x, i, w))

        def join(b: Column) -> Column:
            total = F.transform(b, lambda v: F.aggregate(v, F.lit(0), lambda s, y: s + y))
            shifted = F.zip_with(b, fold(total), lambda v, at: F.transform(fold(v), lambda p: p + at))
            return F.flatten(shifted)

        return _let(blocks, join)

    return F.when(F.size(x) > 0, _let(width, by_blocks)).otherwise(none)


def located(text: Column, pattern: str | Column) -> Column:
    """Every match as (s, e, v): start and end in code points, and the matched text, in order.

    The texts between matches and the matches take turns, so positions are running sums of their lengths.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(found: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.array(F.length(g), F.length(m)))
        # gap, match, gap, match: the sum before a match is its start
        starts = _let(F.flatten(steps), _sums_before)
        put = lambda m, at: F.struct(at.alias("s"), (at + F.length(m)).alias("e"), m.alias("v"))
        return _let(starts, lambda p: F.transform(found, lambda m, i: put(m, F.element_at(p, 2 * i + 2))))

    return _let(F.regexp_extract_all(text, regex, F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """Sorted array of (s, k, e, v): valid matches of all kinds; k is the kind's place in KINDS."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")

    def of(k: int, kind: str) -> Column:
        pattern, gate = PATTERNS[kind]
        good = F.filter(located(text, pattern), lambda x: _valid(kind, x["v"]))
        named = lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"))
        return F.when(text.rlike(gate or pattern), F.transform(good, named)).otherwise(none)

    kinds = [of(k, kind) for k, kind in enumerate(KINDS[:4])]
    return F.coalesce(F.sort_array(F.concat(*kinds)), none)


def entity(k: Column, v: Column) -> Column:
    """What a span stands for: its kind and its value without case, spaces and marks that do not matter."""
    return F.concat(k.cast("string"), F.lit(":"), F.when(k >= 2, _digits(v)).otherwise(F.lower(v)))


def without_emails(text: Column) -> Column:
    """text with spaces in place of e-mail addresses, the only base spans that hold letters; positions stay."""
    pattern = F.lit(PATTERNS["email"][0])
    blank = lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit("")))
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), blank)
    return F.when(text.rlike(PATTERNS["email"][0]), F.array_join(pieces, "")).otherwise(text)


def _row(doc_id: Column, th: Column) -> Column:
    return F.concat_ws(":", text_key(doc_id), th.cast("string"))


def _tiles_of(s: Column, e: Column, reach: int) -> Column:
    """The tile a span starts in and, where it ends beyond the next one, the tile it ends in; packed into one long."""
    first, last = F.floor(s / reach).cast("long"), F.floor((e - 1) / reach).cast("long")
    return first * F.lit(1 << 31) + F.when(last > first + 1, last).otherwise(first)


def context_terms(risky: DataFrame, reach: int = REACH) -> DataFrame:
    """ent, ctx, words, n: the different words, lower-cased, of each context of a base span, and how often it occurs.

    risky: row, text, spans. Texts are cut into tiles of reach code points. The context of a span is the tile it starts
    in and the two beside it, and those about its end where that lies further on; so each side has reach code points
    at least. E-mail addresses are blanked out first, and words that an end of the context cuts are left out. ctx is a
    hash of the context, so that copies of it count once. Texts are cut once, whatever the number of their spans.
    """
    spans = risky.select("row", F.explode("spans").alias("x"))
    at = _tiles_of(F.col("x.s"), F.col("x.e"), reach).alias("at")
    ents = spans.select("row", at, entity(F.col("x.k"), F.col("x.v")).alias("ent")).distinct()

    def about(t: Column, i: Column) -> Column:
        near = F.array_join(F.slice(t, F.greatest(i, F.lit(1)), F.when(i < 1, 2).otherwise(3)), "")
        whole = F.when(i > 1, F.regexp_replace(near, r"^\p{L}+", "")).otherwise(near)
        return F.when(i + 2 < F.size(t), F.regexp_replace(whole, r"\p{L}+$", "")).otherwise(whole)

    def context(t: Column, at: Column) -> Column:
        a, b = F.shiftright(at, 31).cast("int"), at.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.when(a == b, about(t, a)).otherwise(F.concat_ws(" ", about(t, a), about(t, b)))

    cut = F.regexp_extract_all(without_emails(F.col("text")), F.lit(f"(?s).{{1,{reach}}}"), F.lit(0))
    places = F.array_distinct(F.transform("spans", lambda x: _tiles_of(x["s"], x["e"], reach)))
    contexts = _let(cut, lambda t: F.transform(places, lambda p: F.struct(p.alias("at"), context(t, p).alias("c"))))
    found = risky.select("row", F.explode(contexts).alias("x")).select("row", "x.at", "x.c")
    words = F.array_distinct(F.regexp_extract_all(F.lower("c"), F.lit(TERM), F.lit(0)))
    known = found.select("row", "at", F.xxhash64("c").alias("ctx"), words.alias("words")).dropDuplicates(["row", "at"])
    each = ents.join(known, ["row", "at"]).groupBy("ent", "ctx")
    return each.agg(F.first("words").alias("words"), F.count("*").alias("n"))


def disclosing_terms(
    texts: DataFrame, near: DataFrame, threshold: float, support: int, reach: int, least_share: float
) -> DataFrame:
    """term, a: the terms that reveal some entity by corpus statistics, with the most they disclose of any.

    disclosure = PMI(term; entity) / IC(entity), the share of the entity's information that the term gives
    away: PMI = log2(p(term | context of the entity) / p(term)) and IC = -log2 p(entity), all per context
    window, p(term) from the counts of every word of every document. Evidence from fewer than `support`
    different contexts counts for nothing; copies of a context are one. A term of which less than least_share of all
    places, copies included, are in the entity's contexts does not point to it: it is a word of the language.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("tf"))
    pairs = near.select("ent", "n", F.explode("words").alias("term")).groupBy("ent", "term")
    pairs = pairs.agg(F.count("*").alias("both"), F.sum("n").alias("beside"))
    contexts = near.groupBy("ent").agg(F.count("*").alias("seen"))
    held = pairs.filter(F.col("both") >= support).join(contexts, "ent").join(counts, "term", "left")
    held = held.filter(F.col("beside") >= least_share * F.coalesce("tf", F.lit(0)))
    # All windows of the corpus are its code points over the width of a context, which is three tiles.
    windows = texts.agg(F.greatest(F.sum(F.length("text").cast("double")) / (3.0 * reach), F.lit(1.0)).alias("windows"))
    p = held.crossJoin(F.broadcast(windows))  # one row
    pt = F.least(F.greatest("tf", "both") / F.col("windows"), F.lit(1.0))
    pe = F.least(F.col("seen") / F.col("windows"), F.lit(1.0))
    known = p.select("ent", "term", "both", "seen", pt.alias("pt"), pe.alias("pe"))
    share = F.when(F.col("pe") < 1, F.log2(F.col("both") / F.col("seen") / F.col("pt")) / -F.log2("pe")).otherwise(0.0)
    told = known.select("term", share.alias("a")).filter(F.col("a") >= threshold)
    return told.groupBy("term").agg(F.max("a").alias("a"))


def term_places(texts: DataFrame, terms: DataFrame, alternatives: int = 64) -> DataFrame:
    """row, more: sorted array of (s, k, e, a) for every place of a disclosing term in the text, wherever it stands.

    texts: row, text. terms: term (lower case), a. Words are looked up before any is located. A row with up to
    `alternatives` such words is searched for these as it spells them; in one with more every word is located. What is
    found is looked up by itself, so nothing depends on which way was taken.
    """
    each = lambda found: F.explode(F.array_distinct(found)).alias("v")
    words = texts.select("row", each(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))))
    # A struct key hides the known partitioning, so AQE may split a term that many rows have.
    term = lambda v: F.struct(F.lower(v).alias("term")).alias("k")
    told = terms.select(F.struct("term").alias("k"), "a")
    hits = words.select("row", "v", term("v")).join(told, "k").groupBy("row").agg(F.collect_set("v").alias("hits"))
    some = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("hits", "|"), F.lit(r")(?!\p{L})"))
    known = texts.join(materialize(hits.select("row", F.when(F.size("hits") <= alternatives, some).otherwise(TERM).alias("pattern"))), "row")
    placed = known.select("row", F.explode(located(F.col("text"), F.col("pattern"))).alias("x"))
    marked = placed.select("row", "x.s", "x.e", term("x.v")).join(told, "k")
    # Rows that repeat a document give each place again; a set holds it once.
    place = F.struct("s", F.lit(4).alias("k"), "e", "a")
    return marked.groupBy("row").agg(F.sort_array(F.collect_set(place)).alias("more"))


def find_personal_data(
    docs: DataFrame, threshold: float = 0.6, support: int = 2, reach: int = REACH, least_share: float = 0.1
) -> DataFrame:
    """doc_id, th (hash of the text), spans: sorted array of (s, k, e, a) for every row of docs.

    Base spans stay as the patterns find them. Terms (k = 4) that disclose an entity with at least threshold, by the
    words about its spans, and that have least_share of their places about it, are added at all their places in all documents that no base span covers: a, the largest
    disclosure of the term, is then not null. Beside an e-mail address a word begins where the address ends. Null texts
    are empty. Rows that repeat are found alike. An empty table gives an empty result. Work is in proportion to
    the text and, but for a factor of about the cube root in working out places, to the matches in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    th = F.xxhash64(text)
    key = _row(F.col("doc_id"), th).alias("row")
    scan = docs.select("doc_id", th.alias("th"), key, text.alias("text"), base_spans(text).alias("spans"))
    scan = materialize(scan.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    near = materialize(context_terms(scan.filter("text IS NOT NULL").select("row", "text", "spans"), reach))
    terms = materialize(disclosing_terms(docs.select(text.alias("text")), near, threshold, support, reach, least_share))
    per_doc = term_places(docs.select(key, without_emails(text).alias("text")), terms)
    none = F.lit(None).cast("double")
    plain = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), none.alias("a"))
    rows = scan.select("doc_id", "th", "row", F.transform("spans", plain).alias("base")).join(per_doc, "row", "left")
    more = F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int,a:double>>"))
    return rows.select("doc_id", "th", F.sort_array(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitize(docs: DataFrame, remove: float = 0.9, tile: int = 256, **settings) -> DataFrame:
    """Columns of docs, text with base spans and disclosing terms generalised to their kind in brackets; terms of a
    disclosure of `remove` or more are removed. Of overlapping spans the first is written, and the rest is cut.

    Null texts stay null, and texts without a span are passed through. The others are rewritten in tiles, so that the
    work grows with the text and with the spans, not with their product.
    """
    found = find_personal_data(docs, **settings).select(_row(F.col("doc_id"), F.col("th")).alias("id"), "spans")
    found = materialize(found.filter(F.size("spans") > 0).dropDuplicates(["id"]))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = Window.partitionBy("id").orderBy("x.s", "x.k", "x.e").rowsBetween(Window.unboundedPreceding, -1)
    flat = found.select("id", F.explode("spans").alias("x")).withColumn("p", F.coalesce(F.max("x.e").over(before), F.lit(0)))
    put = F.when((F.col("x.s") < F.col("p")) | (F.col("x.a") >= remove), "").otherwise(F.element_at(names, F.col("x.k") + 1))
    cut = flat.select("id", F.greatest("x.s", "p").alias("s"), F.col("x.e").alias("e"), F.coalesce(put, F.lit("")).alias("put"))
    held = F.sequence(F.floor(F.col("s") / tile).cast("int"), F.floor((F.col("e") - 1) / tile).cast("int"))
    parts = cut.filter("e > s").select("id", "s", "e", "put", F.explode(held).alias("t"))
    low = F.col("t") * tile
    local = F.struct(
        F.greatest(F.col("s") - low, F.lit(0)).alias("s"), F.least(F.col("e") - low, F.lit(tile)).alias("e"),
        F.when(F.col("s") >= low, F.col("put")).otherwise("").alias("put"),
    )
    per_tile = parts.groupBy("id", "t").agg(F.sort_array(F.collect_list(local)).alias("cuts"))  # at most tile entries

    text = F.coalesce(F.col("row.text"), F.lit(""))
    row = docs.select(F.struct("*").alias("row")).withColumn("id", _row(F.col("row.doc_id"), F.xxhash64(text)))
    hit = row.join(found.select("id"), "id", "left_semi").select("id", "row.text").dropDuplicates(["id"])
    pieces = hit.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))).alias("t", "c"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col("c"), acc["p"] + 1, x["s"] - acc["p"])
        return F.struct(x["e"].alias("p"), F.concat(acc["t"], kept, x["put"]).alias("t"))

    empty = F.struct(F.lit(0).alias("p"), F.lit("").alias("t"))
    rest = lambda acc: F.concat(acc["t"], F.substring(F.col("c"), acc["p"] + 1, F.lit(tile)))
    written = F.when(F.col("cuts").isNull(), F.col("c")).otherwise(F.aggregate("cuts", empty, step, rest))
    done = pieces.join(per_tile, ["id", "t"], "left").select("id", F.struct("t", written.alias("c")).alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "")
    new = done.groupBy("id").agg(whole.alias("new"))
    both = row.join(new, "id", "left")
    out = F.when(F.col("row.text").isNotNull(), F.coalesce("new", "row.text"))
    return both.select(*[(out if f.name == "text" else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema])
