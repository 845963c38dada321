"""Session operators, batch and streaming: gaps, phases, stores, builds, rate limits, log tails.

Event time and watermarks are an addition to the original's processing time: a watermark of
``LATE`` bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"
BUILD_FRESH_S = 300


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    """(key, start, end, n): runs of a key's events with gaps below ``gap``. Works on batches and streams."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")


def busy_sessions(events: DataFrame, gap: str = "5 minutes", least: int = 20) -> DataFrame:
    """Sessions of the whole log with enough new entries to be summed up."""
    return sessions(events, gap).filter(F.col("n") >= least)


def numbered(events: DataFrame, gap_s: int = 4 * 3600) -> DataFrame:
    """Events with their session's number within the key, by a running sum over gaps."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    new = (_micros() - F.lag(_micros()).over(w) >= gap_s * 1_000_000).cast("int")
    return events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w))


def _step(state: tuple, t: float, tool: str, ok: object) -> tuple:
    """(phase, outcome of the last build or None, its time) after one call."""
    phase, build, build_t = state
    if tool == "Bash" and ok is not None and ok == ok:
        return ("Verify" if ok else "Debug"), bool(ok), t
    if build is not None and t - build_t < BUILD_FRESH_S:
        return ("Verify" if build else "Debug"), build, build_t
    if tool == "Edit":
        phase = "Build"
    elif tool == "Bash" and phase == "Build":
        phase = "Verify"
    elif tool == "Read" and phase == "Unknown":
        phase = "Research"
    return phase, build, build_t


def phases(events: DataFrame) -> DataFrame:
    """(event_id, key, phase): the phase after each call. Rows stream through sorted tasks; state is three values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, ("Unknown", None, 0.0)
        for b in batches:
            out = []
            for e, t, k, tool, ok in zip(b.event_id, b.t, b.key, b.tool, b.ok, strict=True):
                if k != key:
                    key, state = k, ("Unknown", None, 0.0)
                state = _step(state, t, tool, ok)
                out.append(state[0])
            yield pd.DataFrame({"event_id": b.event_id, "key": b.key, "phase": out})

    e = events.select("event_id", (_micros() / 1e6).alias("t"), "key", "tool", "ok", "ts")
    return e.repartition("key").sortWithinPartitions("key", "ts", "event_id").drop("ts").mapInPandas(run, "event_id long, key long, phase string")


def phases_stream(events: DataFrame) -> DataFrame:
    """The same on a stream; a key's state goes after four idle hours."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = state.get if state.exists else ("Unknown", -1, 0.0)
        now = (s[0], None if s[1] < 0 else bool(s[1]), s[2])
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = []
        for t, tool, ok in zip(rows.t, rows.tool, rows.ok, strict=True):
            now = _step(now, t, tool, ok)
            out.append(now[0])
        state.update((now[0], -1 if now[1] is None else int(now[1]), float(now[2])))
        state.setTimeoutTimestamp(max(int(rows.t.max() * 1000) + 4 * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows.event_id, "key": key[0], "phase": out})

    e = events.withWatermark("ts", LATE).select("event_id", (_micros() / 1e6).alias("t"), "key", "tool", "ok", "ts")
    return e.groupBy("key").applyInPandasWithState(run, "event_id long, key long, phase string", "phase string, build int, t double", "append", GroupStateTimeout.EventTimeTimeout)


def calls_since_store(events: DataFrame) -> DataFrame:
    """(event_id, key, calls): calls of the key since its last store, the storing call being the first."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    seg = events.withColumn("seg", F.sum((F.col("tool") == "store").cast("int")).over(w))
    return seg.select("event_id", "key", F.row_number().over(Window.partitionBy("key", "seg").orderBy("ts", "event_id")).alias("calls"))


def nag(calls: Column, phase: Column) -> Column:
    """Whether a reminder to store is due, by the phase's threshold."""
    most = F.when(phase == "Debug", 5).when(phase == "Verify", 8).when(phase == "Build", 12).otherwise(15)
    return calls >= most


def resolved_builds(events: DataFrame) -> DataFrame:
    """(event_id, key): successful builds whose last build before failed."""
    b = events.filter("tool = 'Bash' and ok is not null")
    return b.withColumn("before", F.lag("ok").over(Window.partitionBy("key").orderBy("ts", "event_id"))).filter("ok and not before").select("event_id", "key")


def spaced(events: DataFrame, least_s: int = 120) -> DataFrame:
    """(event_id, key): events at least ``least_s`` after the key's previous one."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    gap = _micros() - F.lag(_micros()).over(w)
    return events.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= least_s * 1_000_000)).select("event_id", "key")


def rate_limit(events: DataFrame, least_s: int = 120) -> DataFrame:
    """(event_id, key): events at least ``least_s`` after the last one that was let through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for b in batches:
            keep = []
            for k, t in zip(b.key, b.t, strict=True):
                ok = k != key or t - last >= least_s * 1_000_000
                if ok:
                    key, last = k, t
                keep.append(ok)
            yield b.loc[keep, ["event_id", "key"]]

    e = events.select("event_id", "key", _micros().alias("t"))
    return e.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, "event_id long, key long")


def once_per_session(injected: DataFrame) -> DataFrame:
    """(ts, session, entry_id) without entries a session had before; on streams within the watermark."""
    if injected.isStreaming:
        return injected.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["session", "entry_id"])
    w = Window.partitionBy("session", "entry_id").orderBy("ts")
    return injected.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def periodic(events: DataFrame, every: str) -> DataFrame:
    """(start, n): events per period, what hourly and six-hourly jobs would see."""
    e = events.withWatermark("ts", LATE) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def tail_count(records: DataFrame, after: int) -> DataFrame:
    """(new, last): live entries past an offset, and the greatest offset."""
    return records.agg(F.count_if(F.col("log_offset") > after).alias("new"), F.max("log_offset").alias("last"))


def ring(events: DataFrame, size: int = 200, dropped: int = 50) -> DataFrame:
    """What a ring buffer per key still holds that drops its oldest ``dropped`` whenever it exceeds ``size``."""
    w = Window.partitionBy("key")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy("ts", "event_id"))
    held = F.when(n <= size, n).otherwise(size - dropped + 1 + F.pmod(n - size - 1, F.lit(dropped)))
    return events.withColumn("_keep", rank > n - held).filter("_keep").drop("_keep")
