"""Near-duplicates: SimHash with pigeonhole blocks and a Hamming check, or exact Jaccard of shingle sets; connected components."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_text, materialize, stored, text_key


def shingle_hashes(shingle: int):
    """f(text) -> XXH64 of every word shingle, repeats included; a text with fewer words is one shingle, a wordless one none."""
    from functools import partial

    import numpy as np
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=42)

    def hashes(text):
        # bytes.lower() touches A-Z only and bytes.split() cuts at ASCII white space only.
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, dtype="<u8")
        if len(words) < shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        return np.fromiter(map(digest, grams), dtype="<u8")

    return hashes


def simhash(h) -> int:
    """The 64-bit SimHash of hashes as a signed long; 0 of none. A bit is set if it is set in over half of them."""
    import numpy as np

    step = 8192
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), step):
        ones += np.unpackbits(h[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint_maker(shingle: int):
    """f(texts) -> {"fp": 64-bit SimHash as a signed long}. Null and wordless texts give 0."""

    def make():
        hashes = shingle_hashes(shingle)
        return lambda texts: {"fp": [simhash(hashes(t)) for t in texts]}

    return make


def fingerprints(docs: DataFrame, shingle: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + fp. A bit is set if it is set in over half of the XXH64 hashes of the word shingles."""
    return map_text(docs, fingerprint_maker(shingle), "fp long", keep)


def _block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of blocks - distance of the blocks; two fingerprints within
    distance differ in at most that many blocks, so they share one of these keys."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def _flips(fp: Column) -> Column:
    """The fingerprint and its 64 one-bit neighbours."""
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << i) >> 63 << 64)).cast("long") for i in range(64)])
    return F.transform(bits, lambda b: fp.bitwiseXOR(b))


def close_links(points: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints: enough of them to connect exactly
    what all pairs within the Hamming distance would connect.

    points: distinct long fp. Fingerprints that share a block key are joined and their
    distance is verified. Block keys shared by more than crowd fingerprints are not
    expanded into pairs: with distance 2, two of them are close exactly if they share a
    one-bit neighbour (or one is the other's), so each is linked to the smallest
    fingerprint under each of its 65 neighbour keys; that is linear in the group.
    """
    if distance != 2:
        raise ValueError("crowded blocks are linked through one-bit neighbours, which is exact for distance 2 only")
    keyed = points.select("fp", F.explode(_block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.n", "k.v")
    counted = keyed.groupBy("n", "v").agg(F.count("*").alias("c"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("c > 1")
    # A struct key hides the known partitioning, so both join sides are shuffled and AQE may split a hot key.
    shared = materialize(counted.select(F.struct("n", "v").alias("k"), "c"))
    rows = keyed.select("fp", F.struct("n", "v").alias("k"))
    tagged = materialize(rows.join(shared, "k"))
    small = tagged.filter(F.col("c") <= crowd)
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = (
        small.groupBy("k").agg(F.collect_list("fp").alias("fps"))  # at most crowd entries each
        .select(F.explode("fps").alias("a"), "fps")
        .select("a", F.explode("fps").alias("b"))
        .filter((F.col("a") < F.col("b")) & far)
    )
    crowded = tagged.filter(F.col("c") > crowd).select("fp").distinct()
    near = crowded.select("fp", F.explode(_flips(F.col("fp"))).alias("at"))
    hub = near.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("c")).filter("c > 1").select(F.struct("at").alias("k"), "a")
    stars = near.select(F.struct("at").alias("k"), F.col("fp").alias("b")).join(hub, "k").filter("a < b").select("a", "b")
    return pairs.union(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes of links (a, b).

    Large-star and small-star steps in turn; each round is a join and a grouping on a
    table written to the shared folder, until nothing changes. Depth falls by a constant factor a round. A round's
    tables go as soon as the next one has read them.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    spark = links.sparkSession
    edges, path = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, before = mark(edges), None
    while before != last:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").select(F.struct("u").alias("k"), "v").join(low, "k").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, middle = stored(large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("k"), "m")
        step = large.select(F.struct("u").alias("k"), "v").join(low, "k").select(F.explode(F.array("v", "k.u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges, after = stored(step)
        discard(spark, path)
        discard(spark, middle)
        path, before, last = after, last, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted_prints(docs: DataFrame, shingle: int, distance: int, blocks: int, crowd: int, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """keep + fp of every row, and fp, low (its smallest doc_id), root (its component's smallest fingerprint)."""
    prints = materialize(fingerprints(docs, shingle, keep))
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(close_links(points.select("fp"), distance, blocks, crowd))
    return prints, points.join(found, points.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicate_components(docs: DataFrame, shingle: int = 5, distance: int = 2, blocks: int = 4, crowd: int = 64, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: keep, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included; null
    doc_ids are never the smallest unless a component holds nothing else. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Rows with one
    doc_id are separate rows. An empty table gives an empty result.
    """
    prints, rooted = _rooted_prints(docs, shingle, distance, blocks, crowd, keep)
    best = rooted.groupBy("root").agg(F.min("low").alias("component_id")).select(F.struct("root").alias("k"), "component_id")
    named = rooted.select("fp", F.struct("root").alias("k")).join(best, "k").select(F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return prints.select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")).join(named, "fingerprint").select(*keep, "fingerprint", "component_id")


def _text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of docs for each root of found (doc_id, th, root): the smallest doc_id, then the smaller text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("w")
    key = lambda doc_id, th: (text_key(doc_id).alias("__id"), th.alias("__th"))
    kept = found.groupBy("root").agg(first).select(*key(F.col("w.doc_id"), F.col("w.th")))
    rows = docs.select(F.struct("*").alias("__row"), *key(F.col("doc_id"), _text_hash()))
    # The window is over the join's own key, so texts move once.
    once = Window.partitionBy("__id", "__th").orderBy(F.lit(0))
    joined = rows.join(kept, ["__id", "__th"], "left_semi")
    return joined.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select("__row.*")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, blocks: int = 4, crowd: int = 64) -> DataFrame:
    """docs without all but one document of each component of close fingerprints: the smallest doc_id
    stays, and of rows that share it the one with the smaller text hash. Columns are those of docs."""
    marked = docs.select("doc_id", "text", _text_hash().alias("th"))
    prints, rooted = _rooted_prints(marked, shingle, distance, blocks, crowd, ("doc_id", "th"))
    # A struct key hides the known partitioning, so AQE may split a fingerprint that many copies share.
    roots = rooted.select(F.struct("fp").alias("k"), "root")
    return _keep_first(docs, prints.select("doc_id", "th", F.struct("fp").alias("k")).join(roots, "k").select("doc_id", "th", "root"))


def _set_maker(shingle: int, prints: bool = False):
    """f(texts) -> node (a hash of the shingle set, signed) and h, the set, sorted; with prints fp, the SimHash of the shingles, too."""

    def make():
        import numpy as np
        import xxhash

        hashes = shingle_hashes(shingle)

        def one(text) -> tuple:
            every = hashes(text)
            s = np.unique(every)
            node = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)
            return (node, s.view("<i8"), simhash(every)) if prints else (node, s.view("<i8"))

        names = ("node", "h", "fp") if prints else ("node", "h")
        return lambda texts: dict(zip(names, zip(*map(one, texts)) if texts else ([],) * len(names), strict=True))

    return make


#: Longs of the narrowest parity map, and the sets it is made for; four times the set takes four times the map.
PARITY_LONGS, PARITY_SET = 8, 1000


def parity_map(hashes, n_longs: int):
    """Bit i tells whether an odd number of the hashes leave the remainder i. Two maps differ in no more bits than
    their sets differ in elements, whatever the width; a wide map folds to a narrow one by the exclusive or of its parts."""
    import numpy as np

    odd = (np.bincount((hashes.view("<u8") % np.uint64(64 * n_longs)).astype(np.int64), minlength=64 * n_longs) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _prefix_maker(shingle: int, least: Fraction, common: list[int]):
    """f(texts) -> node, n (size of the shingle set), fp (the SimHash of the shingles), parity (the set's parity map) and pre, the first n - ceil(least * n) + 1 shingles in an order that
    all texts share: by hash, but common shingles, given from the most frequent on, come last. Two sets of a Jaccard similarity of least share one of these."""

    def make():
        import numpy as np

        sets = _set_maker(shingle, prints=True)()
        order = np.array(common, dtype="<i8").argsort()
        keys, late = np.array(common, dtype="<i8")[order], len(common) - order

        def prefix(s):
            n = len(s)
            if not n:
                return s
            rank = np.zeros(n, dtype=np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                rank = np.where(keys[at] == s, late[at], 0)
            return s[np.argsort(rank, kind="stable")[: n - -(-n * least.numerator // least.denominator) + 1]]

        def parity(s):
            width = PARITY_LONGS
            while len(s) * PARITY_LONGS > PARITY_SET * width and width < PARITY_LONGS * 4**4:
                width *= 4
            return parity_map(s, width)

        def f(texts):
            got = sets(texts)
            return {
                "node": got["node"], "n": [len(s) for s in got["h"]], "fp": got["fp"],
                "parity": [parity(s) for s in got["h"]], "pre": [prefix(s) for s in got["h"]],
            }

        return f

    return make


def common_shingles(docs: DataFrame, shingle: int, sample: int = 10_000, most: int = 200_000) -> list[int]:
    """Hashes of the most frequent shingles of about sample documents, the most frequent first. They only order
    the prefixes: a shingle that is missed makes groups larger, not the result another one."""
    part = max(1, docs.count() // sample)
    some = map_text(docs.filter(F.pmod(F.xxhash64("th"), F.lit(part)) == 0), _set_maker(shingle), "node long, h array<long>", ("th",))
    counts = some.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 2")
    return [r["h"] for r in counts.orderBy(F.desc("c"), "h").limit(most).collect()]


def _folded(p: Column, size: Column) -> Column:
    """A parity map of size longs, from one of that size or four times as large."""
    quarter = lambda i: reduce(Column.bitwiseXOR, [F.get(p, i + k * size) for k in range(4)])
    return F.when(F.size(p) == size, p).otherwise(F.transform(F.sequence(F.lit(0), size - 1), quarter))


def _alike(x: Column, y: Column, least: Fraction) -> Column:
    """Whether two sets (structs with n, parity) can have the similarity: by their sizes, and as the bits in which their
    maps differ are at most the elements in which they do. Sets that have it are never turned away."""
    n, m = x["n"], y["n"]
    sizes = F.least(n, m) * least.denominator >= F.greatest(n, m) * least.numerator
    size = F.least(F.size(x["parity"]), F.size(y["parity"]))
    bits = F.zip_with(_folded(x["parity"], size), _folded(y["parity"], size), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda s, b: s + b)
    # both >= (n + m) * least / (1 + least), and the difference is n + m - 2 * both
    top, bottom = least.denominator - least.numerator, least.denominator + least.numerator
    return sizes & (differ * bottom <= (n + m) * top)


def simhash_pairs(points: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 64) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that fingerprints within the distance suggest: sets of one fingerprint with its smallest node, and the smallest
    nodes of fingerprints that share a block and pass the Hamming check. points: distinct node, fp."""
    low = materialize(points.groupBy("fp").agg(F.min("node").alias("low")))
    named = low.select(F.struct("fp").alias("k"), "low")
    same = points.select(F.struct("fp").alias("k"), "node").join(named, "k").filter("node <> low").select(F.col("low").alias("x"), F.col("node").alias("y"))
    links = close_links(low.select("fp"), distance, blocks, crowd)
    first = links.select(F.struct("a").alias("k"), "b").join(named, "k").select(F.struct("b").alias("k"), F.col("low").alias("x"))
    close = first.join(named, "k").select("x", F.col("low").alias("y"))
    return same.union(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def verified_links(docs: DataFrame, points: DataFrame, pairs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets have a Jaccard similarity of least or more."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    hashes = materialize(points.select("node", "th").join(need, "node", "left_semi").select("th").distinct())
    sets = map_text(docs.join(hashes, "th", "left_semi"), _set_maker(shingle), "node long, h array<long>", ("th",))
    sets = materialize(sets.groupBy("node").agg(F.first("h").alias("h")))
    side = lambda c: sets.select(F.struct(F.col("node").alias(c)).alias("k"), F.col("h").alias(f"h{c}"))
    both = pairs.select(F.struct("a").alias("k"), "b").join(side("a"), "k").select(F.struct("b").alias("k"), F.col("k.a").alias("a"), "ha").join(side("b"), "k")
    met = both.select("a", F.col("k.b").alias("b"), (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("m"))
    return materialize(met.filter(F.col("m") * least.denominator >= (F.col("n") - F.col("m")) * least.numerator).select("a", "b"))


def similar_links(docs: DataFrame, points: DataFrame, shingle: int, least: Fraction, crowd: int = 64, hubs: int = 16) -> DataFrame:
    """Links (a, b), a < b, between nodes: enough of them to connect exactly what all pairs of a Jaccard similarity of least or more would connect.

    docs: th, text. points: distinct node, th (of one text that has the set), n > 0, fp, parity, pre. Every link is verified on the whole sets. First
    come pairs whose fingerprints are close: pigeonhole blocks and a Hamming check find them. Of sets that these links leave apart, those that share a
    prefix shingle and whose parity maps allow the similarity are candidates. Groups of more than crowd sets first meet
    hubs of their sets, which is linear; then only pairs that no links connect yet are tried one by one.
    """
    close = verified_links(docs, points, materialize(simhash_pairs(points, crowd=crowd)), shingle, least)
    joined = components(close).select(F.struct("node").alias("at"), "root")
    rows = points.select(F.explode("pre").alias("h"), "node")
    counted = rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    # A struct key hides the known partitioning, so both join sides are shuffled and AQE may split a hot key.
    shared = materialize(counted.select(F.struct("h").alias("k"), "c"))
    tagged = rows.select(F.struct("h").alias("k"), "node").join(shared, "k").select("k", "c", F.struct("node").alias("at"))
    of = points.select(F.struct("node").alias("at"), "n", "parity").join(joined, "at", "left").select(F.struct("at.node").alias("at"), "n", "parity", F.coalesce("root", "at.node").alias("part"))
    tagged = materialize(tagged.join(of, "at").select("k", "c", F.struct("at.node", "n", "parity", "part").alias("x")))
    small, crowded = tagged.filter(F.col("c") <= crowd), tagged.filter(F.col("c") > crowd).select("k", "x")
    later = F.filter("g", lambda y: (y["node"] > F.col("x.node")) & (y["part"] != F.col("x.part")) & _alike(F.col("x"), y, least))
    pairs = (
        small.groupBy("k").agg(F.collect_list("x").alias("g"))  # at most crowd entries each
        .select(F.explode("g").alias("x"), "g")
        .select(F.col("x.node").alias("a"), F.explode(F.transform(later, lambda y: y["node"])).alias("b"))
    )
    nth = Window.partitionBy("k").orderBy(F.xxhash64("x.node"), "x.node")
    hub = materialize(crowded.withColumn("i", F.row_number().over(nth)).filter(F.col("i") <= hubs).select("k", F.col("x").alias("hub")))
    # Hubs grow with the groups, and rows as small as theirs on disk are large in memory: they are never broadcast.
    near_hub = crowded.join(hub.hint("merge"), "k").filter((F.col("x.part") != F.col("hub.part")) & _alike(F.col("x"), F.col("hub"), least))
    spokes = near_hub.select(F.least("x.node", "hub.node").alias("a"), F.greatest("x.node", "hub.node").alias("b"))
    tried = materialize(pairs.union(spokes).distinct())

    links = close.union(verified_links(docs, points, tried, shingle, least))
    if hub.isEmpty():
        return links
    roots = components(links)
    named = crowded.join(roots, F.col("x.node") == F.col("node"), "left").select("k", "x", F.coalesce("root", "x.node").alias("root"))
    named = materialize(named)
    # The largest component of a group needs no pairs of its own; what lies outside it meets the whole group.
    main = named.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    loose = materialize(named.join(materialize(main.select("k", "main")), "k"))
    x, y = loose.filter("root <> main").select("k", "x", "root").alias("p"), loose.alias("q")
    apart = (F.col("p.root") != F.col("q.root")) & ((F.col("q.root") == F.col("q.main")) | (F.col("p.x.node") < F.col("q.x.node")))
    met = x.join(y, (F.col("p.k") == F.col("q.k")) & apart & _alike(F.col("p.x"), F.col("q.x"), least))
    rest = met.select(F.least("p.x.node", "q.x.node").alias("a"), F.greatest("p.x.node", "q.x.node").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"))
    return links if rest.isEmpty() else links.union(verified_links(docs, points, rest, shingle, least))


def drop_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = 64, hubs: int = 16) -> DataFrame:
    """docs without all but one document of each component of texts whose sets of word shingles have a Jaccard
    similarity of least or more: the smallest doc_id stays, and of rows that share it the one with the smaller text hash.

    Texts whose SimHash fingerprints differ in 2 bits or fewer are linked first, each link verified. Fingerprints alone cannot decide the rest: at a
    similarity of 0.8 about 10 bits differ, give or take 3, and that close lie many texts that have little in common. So what
    the fingerprints leave apart is tried where it shares a shingle of its prefixes, which no such pair fails to do.
    Null, empty and wordless texts are one set. Columns are those of docs.
    """
    bound = Fraction(least).limit_denominator(1000)
    marked = docs.select("doc_id", "text", _text_hash().alias("th"))
    maker = _prefix_maker(shingle, bound, common_shingles(marked, shingle))
    prints = materialize(map_text(marked, maker, "node long, n int, fp long, parity array<long>, pre array<long>", ("doc_id", "th")))
    points = materialize(prints.filter("n > 0").groupBy("node").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("parity").alias("parity"), F.first("pre").alias("pre")))
    found = components(similar_links(marked, points, shingle, bound, crowd, hubs)).select(F.struct("node").alias("k"), "root")
    rooted = prints.select("doc_id", "th", "node", F.struct("node").alias("k")).join(found, "k", "left")
    return _keep_first(docs, rooted.select("doc_id", "th", F.coalesce("root", "node").alias("root")))
