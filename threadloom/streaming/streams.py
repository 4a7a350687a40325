"""Structured Streaming twins of the batch operators: each gives its batch twin's result on the whole input.

All take a streaming DataFrame with a `ts` timestamp and a watermark delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import chunks


def stream_dedup(df: DataFrame, delay: str) -> DataFrame:
    """The first row of every message_uid; later copies within the delay are dropped."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_uid"])


def stream_days(df: DataFrame, delay: str, offset_hours: int = 0) -> DataFrame:
    """conv_id, day, messages per day of a zone with a fixed offset; days are emitted once the watermark has passed them."""
    w = F.window("ts", "1 day", None, f"{(-offset_hours) % 24} hours")
    g = df.withWatermark("ts", delay).groupBy("conv_id", w.alias("w")).agg(F.count("*").alias("messages"))
    return g.select("conv_id", F.date_format(F.col("w.start") + F.make_dt_interval(hours=F.lit(offset_hours)), "yyyy-MM-dd").alias("day"), "messages")


def stream_sessions(df: DataFrame, delay: str, gap: int = 300) -> DataFrame:
    """Bursts of a conversation: messages at most gap seconds apart. Senders and days do not cut them."""
    g = df.withWatermark("ts", delay).groupBy("conv_id", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("messages"))
    return g.select("conv_id", F.unix_timestamp("w.start").alias("start"), (F.unix_timestamp("w.end") - gap).alias("end"), "messages")


def stream_delta(df: DataFrame, min_growth: int = 8) -> DataFrame:
    """conv_id, growth, total: emitted when a conversation has grown by min_growth texts since it was last emitted; smaller growth adds up in its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        total, done = state.get if state.exists else (0, 0)
        for b in batches:
            total += int((b["text"].fillna("").str.len() > 0).sum())
        growth = total - done
        if growth >= min_growth:
            done = total
            yield pd.DataFrame({"conv_id": [key[0]], "growth": [growth], "total": [total]})
        state.update((total, done))

    return df.select("conv_id", "text").groupBy("conv_id").applyInPandasWithState(step, "conv_id string, growth long, total long", "total long, done long", "append", GroupStateTimeout.NoTimeout)


def stream_chunks(df: DataFrame, delay: str, idle: int = 86_400, most: int = 800, overlap: int = 80) -> DataFrame:
    """The chunks of operators.chunks.chunk_messages(), row by row, as messages arrive; ts must rise with canonical_seq.

    Units wait until the watermark has passed their time, so rows may come in any order within the delay; rows that come later are late and
    left out (late_counts() counts them). The last chunk of a conversation is closed by a timer, `idle` seconds after its last message;
    what comes after that opens a chunk with its last `overlap` tokens. Null and blank texts have no part but move the watermark.
    Needs RocksDB as the state store provider.
    """
    # The state operator drops and counts late rows by ts, so ts stays. Spark pushes a filter on texts below the watermark, which rows without a text must move, so these go on to the state operator.
    units = chunks.message_units(df.withWatermark("ts", delay), most, overlap, "ts", blanks=True).withColumn("ms", F.unix_millis("ts"))
    folded = units.groupBy("conv_id").transformWithStateInPandas(
        _chunker(most, overlap, idle * 1000), outputStructType=f"conv_id string, index int, units array<struct<{_fields(chunks.UNIT)}, keep: int>>", outputMode="Append", timeMode="EventTime",
    )
    return chunks.chunk_columns(folded)


def _fields(ddl: str) -> str:
    return ", ".join(f.replace(" ", ": ") for f in ddl.split(", "))


def _chunker(most: int, overlap: int, idle: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = [f.split()[0] for f in chunks.UNIT.split(", ")]
    texts = [f.endswith("string") for f in chunks.UNIT.split(", ")] + [False]
    n_at, seq_at, uid_at, part_at = (names.index(c) for c in ("n", "seq", "uid", "part"))

    class Chunker(StatefulProcessor):
        """waiting: units after the watermark; held: units of the open chunk, and how many tokens of each; open: its number, whether it has
        anything new, the time of the last message and of the next timer."""

        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", f"{chunks.UNIT}, ms long")
            self.held = handle.getListState("held", f"{chunks.UNIT}, keep int")
            self.open = handle.getValueState("open", "index int, fresh boolean, last long, due long")

        def handleInputRows(self, key, rows, timerValues):
            index, fresh, last, due = self.open.get() if self.open.exists() else (0, False, 0, 0)
            real = (b.loc[b["piece"].notna(), [*names, "ms"]].astype(object) for b in rows)
            came = [tuple(None if pd.isna(x) else str(x) if text else int(x) for x, text in zip(r, texts, strict=True)) for b in real for r in b.itertuples(index=False)]
            if came:
                self.waiting.appendList(came)
                first = min(r[-1] for r in came)
                if not due or first < due:
                    due = first
                    self.handle.registerTimer(due)
                self.open.update((index, fresh, last, due))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs()
            index, fresh, last, _ = self.open.get()
            waiting = list(self.waiting.get()) if self.waiting.exists() else []
            held = list(self.held.get()) if self.held.exists() else []
            weight = lambda u: u[-1] or u[n_at]
            total, out = sum(map(weight, held)), []

            def emit():
                nonlocal held, total, index, fresh
                out.append({"conv_id": key[0], "index": index, "units": [dict(zip([*names, "keep"], u, strict=True)) for u in held]})
                tail, left = [], overlap
                for u in reversed(held):
                    if left <= 0:
                        break
                    tail.append(u if weight(u) <= left else (*u[:-1], left))
                    left -= min(left, weight(u))
                held, total, index, fresh = tail[::-1], overlap - left, index + 1, False

            ready = sorted((u for u in waiting if u[-1] <= now), key=lambda u: (u[seq_at], u[uid_at] or "", u[part_at]))
            for u in ready:
                if held and total + u[n_at] > most:
                    emit()
                held.append((*u[:-1], 0))
                total, fresh, last = total + u[n_at], True, max(last, u[-1])
                if total == most:
                    emit()
            later = [u for u in waiting if u[-1] > now]
            if fresh and not later and last + idle <= now:
                emit()
            due = min((u[-1] for u in later), default=last + idle if fresh else 0)
            if due:
                self.handle.registerTimer(due)
            for state, rows in ((self.waiting, later), (self.held, held)):
                state.put(rows) if rows else state.clear()
            self.open.update((index, fresh, last, due))
            if out:
                yield pd.DataFrame(out)

        def close(self):
            pass

    return Chunker()


def late_counts(query) -> int:
    """Rows that a streaming query has rejected as late so far; none is dropped unseen."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
