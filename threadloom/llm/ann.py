"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by their largest part first, so nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class KMeansTree:
    """Inner nodes hold the centres of up to `branch` children; a child is a node or, below 0, leaf ~child.

    spreads: for each child how far the centre of a leaf below it lies from its own at most, 0 for a leaf.
    """

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 8, rounds: int = 8, seed: int = 3):
        self.centers: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.spreads: list[list[float]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.branch, self.rounds, self.least = branch, rounds, max(2, len(sample) / max(1, leaves))
        self.root = self._grow(sample, unit(sample.sum(0, keepdims=True)) if sample.any() else sample[:1])[0]

    def _grow(self, x: np.ndarray, center: np.ndarray) -> tuple[int, np.ndarray]:
        """The node or leaf that holds x, and the centres of its leaves."""
        k = min(self.branch, int(len(x) / self.least))
        if k >= 2:
            c = x[self.rng.choice(len(x), k, replace=False)]
            for _ in range(self.rounds):
                own = (x @ c.T).argmax(1)
                c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
                c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
            own = (x @ c.T).argmax(1)
            used = [j for j in range(k) if (own == j).any()]
            if len(used) >= 2:
                me = len(self.centers)
                self.centers.append(c[used])
                self.children.append([])
                self.spreads.append([])
                below = [self._grow(x[own == j], c[j : j + 1]) for j in used]
                self.children[me] = [child for child, _ in below]
                self.spreads[me] = [float(np.sqrt(((far - c[j]) ** 2).sum(1)).max()) for j, (_, far) in zip(used, below, strict=True)]
                return me, np.vstack([far for _, far in below])
        self.leaves += 1
        return ~(self.leaves - 1), center

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            own = (x[rows] @ self.centers[node].T).argmax(1)
            todo += [(child, rows[own == j]) for j, child in enumerate(self.children[node]) if (own == j).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves in best-bin-first order. The queue yields what can be nearest next: a leaf by
        its centre, a node by the nearest that the centre of a leaf below it can be."""
        queue, out = [(-2.0, self.root)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                continue
            for s, child in zip(self.centers[node] @ q + self.spreads[node], self.children[node], strict=True):
                heapq.heappush(queue, (-float(s), child))
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.Array, pa.ChunkedArray)) else None
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vk (128-bit hash of the vector, as text), v (array of double): rows that take part.

    Null ids, null, empty and zero vectors and those holding null or non-finite parts take none. A repeated
    (vec_id, vector) is one row.
    """
    x = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", x) & F.exists("v", lambda v: v != 0))
    vk = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))
    return ok.select("vec_id", vk.alias("vk"), "v").dropDuplicates(["vec_id", "vk"])


ANSWER = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, **settings) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows by cosine that the search finds, ties to the smaller vec_id.

    A cosine is defined between vectors of one length, so vectors of each length are searched on their own. A query
    is not its own neighbour: rows with its id are none of its candidates. Empty input gives an empty result; fewer
    than k candidates give fewer rows. settings are those of search_length.
    """
    rows = materialize(usable(vectors).withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("d", F.size("v")))
    lengths = sorted(r["d"] for r in rows.select("d").distinct().collect())  # one row per length
    out = vectors.sparkSession.createDataFrame([], ANSWER)
    for d in lengths:
        found = search_length(rows.filter(F.col("d") == d).drop("d"), k, **settings)
        out = found if d == lengths[0] else out.unionByName(found)
    return out


def shards_of(counts: dict[int, int], leaves: int, block: int) -> dict[int, list[int]]:
    """leaf -> its shards: leaves in a row share a shard of up to block rows; a leaf of more has shards of its own."""
    out, shard, room = {}, -1, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if n > block:
            own = -(-n // block)
            out[leaf], shard, room = [*range(shard + 1, shard + 1 + own)], shard + own, 0
            continue
        if n > room:
            shard, room = shard + 1, block
        out[leaf], room = [max(shard, 0)], room - n
    return out


def search_length(
    rows: DataFrame, k: int, recall: float = 0.97, sample: int = 20_000, leaf_rows: int = 32, probes: int = 96, block: int = 2048
) -> DataFrame:
    """The answer of nearest() for rows (vec_id, vk, v, q) whose vectors have one length.

    Equal vectors form one class, which is indexed and searched once and stands for its k + 1
    smallest ids, so thousands of copies cost no more than one vector. The tree is fitted on
    `sample` classes at most; every class is indexed. How many leaves a query visits is calibrated: `probes`
    queries are answered by brute force over all classes, and visits are widened until
    they find `recall` of the true neighbours. Leaves lie in shards of up to `block` classes; a query is sent to a
    shard once, with the leaves it visits there, and meets no other. Of a shard's classes those that can be among the
    best, ties included, are scored once more in double precision, each by itself.
    """
    spark = rows.sparkSession
    want = k + 1
    low = rows.withColumn("n", F.row_number().over(Window.partitionBy("vk").orderBy("vec_id"))).filter(F.col("n") <= want)
    lists = low.groupBy("vk").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("v").alias("v"))
    asked = rows.filter("q").select(F.col("vk").alias("ak")).distinct()
    marked = lists.join(asked, F.col("vk") == F.col("ak"), "left").select("vk", "ids", "v", F.col("ak").isNotNull().alias("q"))
    classes = materialize(marked)
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64(F.lit("tree"), "vk"), "vk").limit(sample).select("v").toArrow()
    tree = KMeansTree(unit(_matrix(drawn["v"].combine_chunks())), math.ceil(n / leaf_rows))

    def index(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.leaf_of(unit(_matrix(b.column(b.schema.get_field_index("v")))))
                yield b.append_column("leaf", pa.array(leaf, type=pa.int32()))

    indexed = materialize(classes.mapInArrow(index, classes.withColumn("leaf", F.lit(0)).schema))

    # Calibration: the true neighbours of a few queries, from all classes in blocks.
    probe = indexed.filter("q").orderBy(F.xxhash64(F.lit("probe"), "vk"), "vk").limit(probes).select("vk", "v").toArrow()
    if not probe.num_rows:
        return spark.createDataFrame([], ANSWER)
    pq = unit(_matrix(probe["v"].combine_chunks()))

    def brute(batches):
        best = np.full((len(pq), want), -2.0)
        leaf = np.zeros((len(pq), want), dtype=np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            s = pq @ unit(_matrix(b.column(b.schema.get_field_index("v")))).T
            lf = b.column(b.schema.get_field_index("leaf")).to_numpy()
            both, leaves = np.hstack([best, s]), np.hstack([leaf, np.broadcast_to(lf, s.shape)])
            top = np.argpartition(-both, want - 1, axis=1)[:, :want]
            best, leaf = np.take_along_axis(both, top, 1), np.take_along_axis(leaves, top, 1)
        p, c = np.nonzero(best > -2)
        yield pa.RecordBatch.from_pydict({"p": pa.array(p.astype(np.int32)), "leaf": pa.array(leaf[p, c]), "s": pa.array(best[p, c])})

    true = indexed.select("v", "leaf").mapInArrow(brute, "p int, leaf int, s double")
    best_of = Window.partitionBy("p").orderBy(F.desc("s"), "leaf")
    near = true.withColumn("r", F.row_number().over(best_of)).filter(F.col("r") <= want).select("p", "leaf").collect()  # probes * want rows
    order = [{leaf: i for i, leaf in enumerate(tree.best_bins(q, tree.leaves))} for q in pq]
    depth = np.array([order[r["p"]][r["leaf"]] for r in near])
    visits = 1
    while visits < tree.leaves and (depth < visits).mean() < recall:
        visits += max(1, visits // 8)

    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row per leaf, which the sample bounds
    shards = shards_of(counts, tree.leaves, block)

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, v = b.column("vk").to_pylist(), b.column("v")
            row, to, leaves = [], [], []
            for i, x in enumerate(unit(_matrix(v))):
                per: dict[int, list[int]] = {}
                for leaf in tree.best_bins(x, visits):
                    for s in shards[leaf]:
                        per.setdefault(s, []).append(leaf)
                row += [i] * len(per)
                to += per.keys()
                leaves += per.values()
            cols = [pa.array([keys[i] for i in row]), v.take(pa.array(row)), pa.array(to, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["qk", "v", "s", "leaves"])

    queries = indexed.filter("q").select("vk", "v")
    routed = queries.mapInArrow(spread, "qk string, v array<double>, s int, leaves array<int>")
    # Queries of one block meet a shard in one task.
    blocks = max(1, math.ceil(queries.count() / block))
    own = F.create_map(*[x for leaf, s in shards.items() if len(s) > 1 for x in (F.lit(leaf), F.array(*map(F.lit, s)))]) if any(len(s) > 1 for s in shards.values()) else None
    first = F.element_at(F.array(*[F.lit(shards[leaf][0]) for leaf in range(tree.leaves)]), F.col("leaf") + 1)
    many = own[F.col("leaf")] if own is not None else F.lit(None).cast("array<int>")
    shard = F.when(many.isNull(), first).otherwise(F.element_at(many, (F.pmod(F.xxhash64("vk"), F.size(many)) + 1).cast("int")))
    left = routed.withColumn("t", F.pmod(F.xxhash64("qk"), F.lit(blocks)).cast("int"))
    right = indexed.select("ids", "v", "leaf", shard.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("t"))

    def match(q: pa.Table, c: pa.Table) -> pa.Table:
        out = {"qk": [], "ids": [], "score": []}
        if q.num_rows and c.num_rows:
            c = c.sort_by("leaf")
            a, b = unit(_matrix(q["v"].combine_chunks())), unit(_matrix(c["v"].combine_chunks()))
            keys, ids, leaf = q["qk"].to_pylist(), c["ids"].to_pylist(), c["leaf"].to_numpy()
            asks: dict[int, list[int]] = {}
            for i, some in enumerate(q["leaves"].to_pylist()):
                for x in some:
                    asks.setdefault(x, []).append(i)
            s = np.full((len(a), len(b)), -2.0)
            for x, who in asks.items():
                lo, hi = np.searchsorted(leaf, [x, x + 1])
                s[who, lo:hi] = a[who] @ b[lo:hi].T
            # The product's last bits depend on its blocking: what may be among the best is scored one by one.
            at = max(0, len(b) - want)
            least = np.partition(s, at, axis=1)[:, at] - 1e-9
            for r in range(len(a)):
                top = np.flatnonzero(s[r] >= max(least[r], -1.5))
                exact = np.clip((b[top] * a[r]).sum(1), -1.0, 1.0)
                for e, t in sorted(zip(-exact, top, strict=True), key=lambda x: (x[0], ids[x[1]][0]))[:want]:
                    out["qk"].append(keys[r])
                    out["ids"].append(ids[t])
                    out["score"].append(-float(e))
        return pa.table(out, schema=pa.schema([("qk", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    found = left.groupBy("s", "t").cogroup(right.groupBy("s", "t")).applyInArrow(match, "qk string, ids array<long>, score double")
    ranked = Window.partitionBy("qk").orderBy(F.desc("score"), F.col("ids")[0])
    classes_best = found.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= want)
    scored = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("m"), i.alias("id")))
    listed = classes_best.groupBy("qk").agg(F.flatten(F.collect_list(scored)).alias("all"))
    listed = listed.select(F.concat(F.lit("="), "qk").alias("key"), F.slice(F.array_sort("all"), 1, want).alias("all"))
    # The queries of one class share its answer, each without itself.
    ask = rows.filter("q").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("="), "vk").alias("key"))
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k).alias("all")
    answers = ask.join(listed, "key").select("query_id", others).select("query_id", F.posexplode("all").alias("p", "x"))
    return answers.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.m")).alias("score"))
