"""Best-fit packing with Martello-Toth dominance reduction, on the histogram of lengths.

Pieces of one length are interchangeable, so the plan is made on counts per length:
at most `capacity` rows reach the driver, whatever the corpus holds. The plan says how
many sequences follow each pattern of lengths; every piece then finds its slot by its
rank among the pieces of its length, which Spark counts in parallel.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bucket, map_text, materialize, running_offsets, worker_cache

#: Entries of a worker's word cache; it is emptied when full.
CACHE_WORDS = 150_000
#: Words that are one run of lower-case letters (composed, so NFC leaves them) and then ASCII marks.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: The splitting expression of tokenizers that drop white space and keep letter runs whole (fixed value, as their files have it).
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds(dict):
    """word bytes -> its token ids as little-endian uint32 bytes.

    Where the tokenizer drops white space before it splits, the ids of a text are those of its
    words in a row. A plain letter run is one pre-token: it goes to the model at once, past the
    normalizer and the splitting expression, which take most of the tokenizer's time. Texts of
    other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = first.get("behavior") == "Removed" and bool(first.get("invert")) and first["pattern"].get("Regex") == LETTER_RUNS
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = {i: step.pre_tokenize_str(chr(i))[0][0] for i in [*range(0x61, 0x7B), *range(0xDF, 0x100)]}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode()
        m = PLAIN.fullmatch(text) if len(word) < 64 else None
        if m and m[2]:
            got = self[m[1].encode()] + self[m[2].encode()]
        elif m:
            got = self._pack([t.id for t in self.tok.model.tokenize(text.translate(self.table))])
        else:
            got = self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        self[word] = got
        return got

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        raw = text.encode()
        # Special tokens are matched before case is folded, so their texts keep their case.
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


def pieces_maker(tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    def make():
        cache = worker_cache("word_ids")
        words = cache.get(tokenizer_path) or cache.setdefault(tokenizer_path, WordIds(tokenizer_path))
        end, width = end_id.to_bytes(4, "little"), 4 * capacity

        def run(texts: list) -> dict:
            out = []
            for t in texts:
                ids = (words.text(t) if t else b"") + end
                cut = [ids[i : i + width] for i in range(0, len(ids), width)]
                out.append([{"piece": k, "start": k * capacity, "length": len(c) // 4, "ids_crc32": zlib.crc32(c)} | ({"ids": memoryview(c).cast("I").tolist()} if with_ids else {}) for k, c in enumerate(cut)])
            return {"pieces": out}

        return run

    return make


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: keep, piece, start, length, ids_crc32 (of the little-endian uint32 ids) and, with_ids, ids.

    A document is the ids of its text, then end_id; null and empty texts are end_id alone.
    Only documents longer than capacity are cut.
    """
    fields = "piece:int,start:long,length:long,ids_crc32:long" + ",ids:array<int>" * with_ids
    rows = map_text(docs, pieces_maker(tokenizer_path, capacity, end_id, with_ids), f"pieces array<struct<{fields}>>", keep, cache="word_ids")
    return rows.select(*keep, F.inline("pieces"))


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate every alternative and take them out of counts: [(lengths of a set, how many)].

    For the longest length j left, and k the longest that fits beside it:
    nothing fits -> {j} alone; k fills it up exactly -> {j, k}; only one more item
    fits beside j at all -> {j, k}; no three more fit and the best two together are no
    longer than k -> {j, k}, since k could be exchanged for them. When none holds, the
    next shorter length is tried.
    """
    fixed = []
    lengths = sorted(l for l, n in counts.items() if n > 0)

    def use(l: int, n: int) -> None:
        counts[l] -= n
        if not counts[l]:
            del counts[l]
            lengths.pop(bisect_left(lengths, l))

    def longest(room: int, taken: dict[int, int]) -> int:
        """The longest length of at most room with an item left besides taken; 0 if none."""
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and counts[lengths[at]] <= taken.get(lengths[at], 0):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def pair_sum(room: int, taken: dict[int, int]) -> int:
        """The largest sum of two items within room; 0 if no two fit."""
        best, lo, hi = 0, 0, bisect_left(lengths, room) - 1
        free = lambda l: counts[l] - taken.get(l, 0)
        while 0 <= lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if a + b > room:
                hi -= 1
            elif free(a) <= 0:
                lo += 1
            elif free(b) <= 0:
                hi -= 1
            elif lo == hi:
                best = max(best, 2 * a if free(a) >= 2 else 0)
                break
            else:
                best = max(best, a + b)
                # a's best partner may be a shorter one only if b has run out, which free(b) rules out
                if free(a) >= 2 and lo + 1 > hi:
                    best = max(best, 2 * a)
                lo += 1
        return best

    def three_fit(room: int, taken: dict[int, int]) -> bool:
        """Whether the three shortest items fit."""
        need = 3
        for l in lengths:
            n = min(need, counts[l] - taken.get(l, 0))
            need, room = need - n, room - n * l
            if not need or room < 0:
                break
        return need == 0 and room >= 0

    todo = lengths[::-1]
    for j in todo:
        while counts.get(j, 0) > 0:
            room, taken = capacity - j, {j: 1}
            k = longest(room, taken)
            if k == 0:
                # The shortest item left does not fit beside j, and only j's own copies could be shorter: none.
                n = counts[j]
                fixed.append(((j,), n))
                use(j, n)
                continue
            if k != room and (three_fit(room, taken) or pair_sum(room, taken) > k):
                break
            # All copies of j meet the same partners until k runs out.
            n = counts[j] // 2 if j == k else min(counts[j], counts[k])
            fixed.append(((j, k), n))
            use(j, n)
            use(k, n)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on counts: [([(length, items), ...], sequences of this pattern)].

    Each length goes to the open sequences with the least room that still holds it;
    a sequence with least room stays the best choice until it is full, so sequences with
    one pattern are filled together. Every length splits at most a few groups, so
    groups stay in proportion to the number of lengths.
    """
    groups: dict[int, list] = defaultdict(list)  # room -> [(pattern, count)]
    rooms: list[int] = []

    def put(room: int, pattern: list, n: int) -> None:
        if room not in groups:
            insort(rooms, room)
        groups[room].append((pattern, n))

    def take(room: int):
        got = groups[room].pop()
        if not groups[room]:
            del groups[room]
            rooms.pop(bisect_left(rooms, room))
        return got

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = take(room)
            else:
                room, pattern, n = capacity, [], -(-left // (capacity // length))
            each = room // length
            full = min(n, left // each)
            if full:
                put(room - each * length, [*pattern, (length, each)], full)
                left -= full * each
            if n > full:
                if left and left < each:
                    put(room - left * length, [*pattern, (length, left)], 1)
                    left, full = 0, full + 1
                if n > full and pattern:
                    put(room, pattern, n - full)
    return [(p, n) for room in rooms for p, n in groups[room]]


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, per sequence, first offset).

    Ranks r = first rank + i of a length go to sequence first sequence + i // per sequence, at
    offset first offset + (i % per sequence) * length.
    """
    counts = dict(histogram)
    fixed = [([(l, 1) for l in s] if len(set(s)) == len(s) else [(s[0], 2)], n) for s, n in reduce_dominated(counts, capacity)]
    runs, used, sequence = [], defaultdict(int), 0
    for pattern, n in fixed + best_fit(counts, capacity):
        offset = 0
        for length, each in pattern:
            runs.append((length, used[length], n * each, sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    return runs


def place_maker(runs: list[tuple]):
    """f over Arrow batches with length and rank: adds sequence_id and offset."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        r = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
        starts = r[:, 0] * (1 << 50) + r[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = r[np.searchsorted(starts, length * (1 << 50) + rank, side="right") - 1]
            i = rank - at[:, 1]
            new = {"sequence_id": at[:, 3] + i // at[:, 4], "offset": at[:, 5] + i % at[:, 4] * length}
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *(pa.array(v) for v in new.values())], names=[*names, *new])

    return run


def pack(rows: DataFrame, capacity: int = 4096, key: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """rows (with length, 1 to capacity) + sequence_id, offset: as few sequences of at most capacity as the method finds.

    Offsets are gapless from 0. Buckets are dealt by the hash of key, which tells rows that share or lack a doc_id
    apart by what they hold. Rows equal in key and length may swap places; nothing else depends on
    the order of the input. rows should be a stored table: it is read twice. An empty table gives an empty one.
    """
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = plan_slots(histogram, capacity)
    order = F.md5(F.concat_ws("/", *(F.col(k).cast("string") for k in key)))
    hashed = rows.withColumn("__h", order).withColumn("__b", hash_bucket(F.col("__h"), sum(histogram.values()) or 1)).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_offsets(hashed, "length", "__b", ["__h", *key], "__one", "rank").select(*rows.columns, "rank")
    out = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(place_maker(runs), out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Repeated rows are packed once each. Null doc_ids are kept. Texts are tokenized whole, once;
    the pieces are stored in the shared folder before they are planned.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)
