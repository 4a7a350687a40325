"""SentencePiece encoding in vectorised merge rounds, and decoding.

A model of kind BPE merges, again and again, the two neighbours whose joint piece has the best score, the leftmost of
equals first. Here a batch of texts becomes one flat array of symbols cut into words, and every round merges in all words at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text, worker_cache

#: The mark that stands for a space, and the type numbers of a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max
#: Characters that are encoded at once; a longer text is a batch of its own.
BATCH = 2_000_000


class Codec:
    """A BPE model with identity normalisation, as tables that numpy can search."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with identity normalisation and without user-defined or unused pieces are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.size = len(proto.pieces)
        self.eos = next((i for i, p in enumerate(proto.pieces) if p.piece == trained.eos_piece), None)
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        names = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        in_bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = np.array([in_bytes[b] for b in range(256)], dtype=np.int32) if trained.byte_fallback else None
        # A symbol is a piece's id, or size + code point for a character that is no piece.
        self.symbols = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in names.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        score = np.array([p.score for p in proto.pieces], dtype=np.float32)
        order = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        number = lambda s: names.get(s, int(self.symbols[ord(s)]) if len(s) == 1 else None)
        pairs = [(a, b, names[p]) for p in names for i in range(1, len(p)) if (a := number(p[:i])) is not None and (b := number(p[i:])) is not None]
        self.base = self.size + 0x110000
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        keys = table[:, 0] * self.base + table[:, 1]
        self._hash_pairs(keys, table[:, 2].astype(np.int32), order)
        # Merging into a risky piece can make a pair of no worse a rank, which then comes first.
        self.risky = np.zeros(self.base, dtype=bool)
        for side in (0, 1):
            of = table[:, side]
            known = of < self.size
            early = order[table[known, 2]] <= order[of[known]]
            self.risky[of[known][early]] = True
        # No merge ever crosses two characters that no piece holds side by side.
        grams = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        self.grams = np.unique(np.array([ord(g[0]) * 0x110000 + ord(g[1]) for g in grams], dtype=np.int64))
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(g[1] == SPACE != g[0] for g in grams) else "(?s).+")
        self.run = self._space_run(names, score)
        self.surface = self._surfaces(proto)

    def _space_run(self, names: dict, score: np.ndarray) -> int | None:
        """The length of space runs that always become pieces of their own, from the left: where the pieces of spaces alone
        have one score, so that the leftmost pair is next, and no other piece holds two spaces in a row."""
        self.run = None
        alone = [p for p in names if len(p) > 1 and set(p) == {SPACE}]
        if not alone or len({score[names[p]] for p in alone}) > 1 or any(SPACE * 2 in p and set(p) != {SPACE} for p in names):
            return None
        longest = max(map(len, alone))
        return longest if len(self._encode_words([SPACE * longest])[0]) == 1 else None

    def _surfaces(self, proto) -> list[bytes]:
        def of(p):
            if p.type == BYTE:
                return bytes([int(p.piece[3:5], 16)])
            if p.type == CONTROL:
                return b""
            return (proto.trainer_spec.unk_surface if p.type == UNKNOWN else p.piece.replace(SPACE, " ")).encode()

        self.kind = np.array([p.type for p in proto.pieces], dtype=np.int8)
        self.leads = [p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        return [of(p) for p in proto.pieces]

    def _hash_pairs(self, keys: np.ndarray, joined: np.ndarray, order: np.ndarray) -> None:
        """Hash tables of the pairs: what finds its slot taken goes to the next, smaller table."""
        bits = max(4, (8 * len(keys)).bit_length() - 1)
        self.tables = []
        while len(keys):
            slot = self._slot(keys, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, piece = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
            held[slot[first]], piece[slot[first]] = keys[first], joined[first]
            self.tables.append((bits, held, piece, order[piece]))
            left = np.ones(len(keys), dtype=bool)
            left[first] = False
            keys, joined, bits = keys[left], joined[left], max(4, bits - 2)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * level) & (2**64 - 1) | 1)
        return ((keys.view(np.uint64) * odd) >> np.uint64(64 - bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint piece of symbol pairs; rank NONE where they have none."""
        keys = left.astype(np.int64) * self.base + right
        rank, joint = np.full(len(keys), NONE, dtype=np.int32), np.full(len(keys), -1, dtype=np.int32)
        rest = np.arange(len(keys))
        for level, (bits, held, piece, order) in enumerate(self.tables):
            slot = self._slot(keys[rest] if level else keys, bits, level)
            found = held[slot]
            hit = found == (keys[rest] if level else keys)
            at = slot[hit]
            rank[rest[hit]], joint[rest[hit]] = order[at], piece[at]
            rest = rest[~hit & (found >= 0)]
            if not len(rest):
                break
        return rank, joint

    def _cut(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words are cut into segments that no merge crosses: a mask of segment starts."""
        first = np.zeros(len(points), dtype=bool)
        first[starts] = True
        keys = points[:-1].astype(np.int64) * 0x110000 + points[1:]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        first[1:] |= self.grams[at] != keys
        if self.run:
            space = points == ord(SPACE)
            opens = space & ~np.concatenate([[False], space[:-1]])
            opens[starts] = True
            nth = np.arange(len(points)) - np.maximum.accumulate(np.where(opens, np.arange(len(points)), 0))
            first |= space & (nth > 0) & (nth % self.run == 0)
        return first

    def _merge(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the segment of each; first marks the starts of segments."""
        segment = np.cumsum(first) - 1
        done_sym, done_seg = [], []
        rank, joint = self._next_pairs(sym, first)
        while True:
            starts = np.flatnonzero(first)
            low = np.minimum.reduceat(rank, starts) if len(starts) else rank[:0]
            sizes = np.diff(np.append(starts, len(sym)))
            live = np.repeat(low != NONE, sizes)
            if not live.all():  # compaction: finished segments leave
                done_sym.append(sym[~live])
                done_seg.append(segment[~live])
                sym, first, segment, rank, joint = (x[live] for x in (sym, first, segment, rank, joint))
                low, sizes = low[low != NONE], sizes[low != NONE]
            if not len(sym):
                break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            # Of overlapping pairs every other one merges, from the left.
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            at = self._undisturbed(sym, first, segment, rank, joint, at)
            sym[at] = joint[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, first, segment, rank, joint = (x[keep] for x in (sym, first, segment, rank, joint))
            # Only the pairs at a merged symbol are new.
            fresh = np.zeros(len(sym), dtype=bool)
            fresh[moved] = True
            fresh[moved[moved > 0] - 1] = True
            rank[fresh] = NONE
            fresh[:-1] &= ~first[1:]
            near = np.flatnonzero(fresh[:-1])
            rank[near], joint[near] = self._pairs(sym[near], sym[near + 1])
        seg = np.concatenate(done_seg) if done_seg else segment
        out = np.concatenate(done_sym) if done_sym else sym
        order = np.argsort(seg, kind="stable")
        return out[order], seg[order]

    def _next_pairs(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, joint = np.full(len(sym), NONE, dtype=np.int32), np.full(len(sym), -1, dtype=np.int32)
        inner = np.flatnonzero(~first[1:])
        rank[inner], joint[inner] = self._pairs(sym[inner], sym[inner + 1])
        return rank, joint

    def _undisturbed(self, sym, first, segment, rank, joint, at) -> np.ndarray:
        """The merges of this round up to the first of each segment that makes a pair of no worse a rank, which would come before the rest."""
        bad = self.risky[joint[at]]
        if not bad.any():
            return at
        spots = np.flatnonzero(bad)
        worst = rank[at[spots]]
        stop = np.zeros(len(at), dtype=bool)
        right = at[spots] + 2
        ok = (right < len(sym)) & ~first[np.minimum(right, len(sym) - 1)]
        stop[spots[ok]] = self._pairs(joint[at[spots[ok]]], sym[right[ok]])[0] <= worst[ok]
        left = at[spots] - 1
        ok = (left >= 0) & ~first[at[spots]]
        merged = np.zeros(len(sym), dtype=bool)
        merged[at] = True
        before = left[ok]
        other = np.where(merged[np.maximum(before - 1, 0)] & (before > 0), joint[np.maximum(before - 1, 0)], sym[before])
        stop[spots[ok]] |= self._pairs(other, joint[at[spots[ok]]])[0] <= worst[ok]
        # A merge counts only if no earlier one of its segment stops.
        opens = np.flatnonzero(np.diff(segment[at], prepend=-1) != 0)
        stops = np.cumsum(stop) - stop
        return at[stops == np.repeat(stops[opens], np.diff(np.append(opens, len(at))))]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(length) - length
        first = self._cut(points, starts)
        sym, seg = self._merge(self.symbols[points], first)
        word = np.searchsorted(starts, np.flatnonzero(first), side="right") - 1
        counts = np.bincount(word[seg], minlength=len(words))
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):  # characters without a piece
            width = np.ones(len(sym), dtype=np.int64)
            if self.byte_ids is None:
                ids = np.where(sym >= self.size, self.unk, sym)
            else:
                raw = [chr(c).encode() for c in sym[odd] - self.size]
                width[odd] = [len(r) for r in raw]
                ids = np.repeat(sym, width)
                ids[ids >= self.size] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
                counts = np.bincount(np.repeat(word[seg], width), minlength=len(words))
        else:
            ids = sym
        return ids.astype(np.int32), counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without a start or end id. Words that repeat are merged once."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            out += self._encode_some(texts[at:end])
            at = end
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        known: dict[str, int] = defaultdict()
        known.default_factory = known.__len__
        codes, ends = [], []
        for t in texts:
            if t:
                t = (SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)
                codes += map(known.__getitem__, self.words.findall(t))
            ends.append(len(codes))
        ids, counts = self._encode_words(list(known))
        starts = np.cumsum(counts) - counts
        codes = np.array(codes, dtype=np.int64)
        each = counts[codes]
        after = np.cumsum(each)
        flat = ids[np.repeat(starts[codes] - (after - each), each) + np.arange(int(after[-1]) if len(after) else 0)]
        cuts = np.concatenate([[0], after])[np.array(ends, dtype=np.int64)]
        split = np.split(flat, cuts[:-1]) if len(cuts) else []
        if self.byte_ids is None:  # a run of unknown characters is one id
            split = [x[~((x == self.unk) & (np.concatenate([[-1], x[:-1]]) == self.unk))] for x in split]
        return split

    def decode(self, ids) -> str:
        """The text of ids: spaces for marks, without the one in front; bytes that are no UTF-8 become U+FFFD one by one."""
        ids = list(ids)
        if any(not 0 <= i < self.size for i in ids):
            raise ValueError("an id is not in the model")
        parts = [self.surface[i] for i in ids]
        if self.dummy_prefix:
            at = next((n for n, p in enumerate(parts) if p), None)
            if at is not None and self.leads[ids[at]]:
                parts[at] = parts[at][1:]
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids, parts)

    def _decode_bytes(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for i, p in zip([*ids, None], [*parts, b""], strict=True):
            if i is not None and self.kind[i] == BYTE:
                run += p
                continue
            while run:
                wide = next((n for n in (1, 2, 3, 4) if _is_character(run[:n])), 0)
                out.append(run[:wide].decode() if wide else "�")
                run = run[wide or 1 :]
            out.append(p.decode())
        return "".join(out)


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


def model_bytes(path: str) -> bytes:
    """The model file; it is about half a megabyte and travels with the tasks."""
    return Path(path).read_bytes()


def _codec(model: bytes) -> Codec:
    cache = worker_cache("pieces")
    if "codec" not in cache or cache["model"] != model:
        cache["model"], cache["codec"] = model, Codec(model)
    return cache["codec"]


def encode_pieces(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), eos: bool = True) -> DataFrame:
    """keep + ids array<int>, one row per row of docs.

    A null text is empty; an empty one has the end id only, or nothing. Repeated rows stay rows of their own, an empty table
    gives an empty result, and very long texts are merged whole, as one batch; other columns of docs play no part.
    """
    def make():
        codec = _codec(model)
        tail = np.array([codec.eos] if eos else [], dtype=np.int32)
        return lambda texts: {"ids": [np.concatenate([i, tail]) for i in codec.encode([t or "" for t in texts])]}

    return map_text(docs, make, "ids array<int>", keep, cache="pieces")


def encode_decode(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), eos: bool = True) -> DataFrame:
    """encode_pieces() and the text that decoding its ids gives, in one pass: keep + ids, decoded."""
    def make():
        codec = _codec(model)
        tail = np.array([codec.eos] if eos else [], dtype=np.int32)

        def f(texts):
            ids = [np.concatenate([i, tail]) for i in codec.encode([t or "" for t in texts])]
            return {"ids": ids, "decoded": [codec.decode(i.tolist()) for i in ids]}

        return f

    return map_text(docs, make, "ids array<int>, decoded string", keep, cache="pieces")


def decode_pieces(rows: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep + text of the array of ids; null ids give a null text. An id outside the model is an error."""
    def make():
        codec = _codec(model)
        return lambda lists: {"text": [None if x is None else codec.decode(x) for x in lists]}

    return map_text(rows, make, "text string", keep, text=ids, cache="pieces")
