"""Causal operators as Structured Streaming queries over an event topic.

Each function takes a streaming DataFrame with ``ts`` (event time) and returns a streaming
DataFrame; :func:`drain` runs one over what a file source holds and hands back the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators import play
from touchline.sources.scratch import scratch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark: SparkSession, stream: DataFrame, mode: str, on_progress: Callable | None = None) -> DataFrame:
    """Run to the end of the available input; micro-batch n is the folder ``batch=n``, replaced whole if it is retried."""
    out = scratch(spark, "stream")
    conf = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(conf, None)
    spark.conf.set(conf, STATE_STORE)
    try:
        q = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", scratch(spark, "offsets"))
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        q.awaitTermination()
        if on_progress:
            on_progress(q.recentProgress)
    finally:
        spark.conf.unset(conf) if was is None else spark.conf.set(conf, was)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """Newest version of every key of an update-mode result."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r")).select(*keys, "r.*")


def ppda_windows(s: DataFrame, size: str = "300 seconds", delay: str = "10 seconds") -> DataFrame:
    """Tumbling passes and defensive actions per defending side."""
    w = play.press_counts(s.withWatermark("ts", delay)).groupBy("match_id", "dteam", F.window("ts", size).alias("w"))
    return w.agg(F.sum("is_pass").alias("passes"), F.sum("is_action").alias("actions"))


def unique_rows(s: DataFrame, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    """Rows repeated within the watermark are dropped."""
    return s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def sessions(s: DataFrame, keys: list[str], gap: str, delay: str = "0 seconds") -> DataFrame:
    """Session windows closed by a pause of ``gap``."""
    g = s.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dropped(progress: list) -> int:
    """Rows that stateful operators dropped because they came after the watermark, from a query's progress reports."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)


def resampled(s: DataFrame, keys: list[str], value: str, every: str, delay: str = "10 seconds") -> DataFrame:
    """Mean and count of ``value`` in steps of ``every``, each written once it is complete."""
    w = s.withWatermark("ts", delay).groupBy(*keys, F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias(value))
    return w.select(*keys, F.col("w.start").alias("start"), "n", value)


class InOrder(StatefulProcessor):
    """Rows of a key in event time, whatever order and micro-batches they arrive in.

    Arriving rows wait in state. A timer at the earliest of them fires when the watermark has passed it; all rows up to the
    watermark are then taken out, sorted and given to :meth:`take`, each once. What arrives after the watermark never
    reaches the processor: Spark drops and counts it (the watermark begins at the epoch). So state holds the rows of the watermark's delay and what a subclass
    keeps of the past. ``fields`` begins with the time in microseconds and a number that settles ties.
    """

    fields = "clock_us long, event_id long"
    #: Rows are released in whole multiples of so many microseconds.
    step = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.names = [f.split()[0] for f in self.fields.split(", ")]

    def _wake_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(part[self.names].itertuples(index=False, name=None))
            if new:
                self.waiting.appendList(new)
                low = min(r[0] for r in new)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake_at(first // self.step * self.step + self.step)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 // self.step * self.step
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < upto]
        rest = rows[len(ready) :]
        if not ready:
            return iter(())
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest[0][0] // self.step * self.step + self.step)
        else:
            self.waiting.clear()
        return iter((self.take(key, ready, upto),))

    def take(self, key, rows: list[tuple], upto: int) -> pd.DataFrame:
        """The result of ``rows``, the next ones of ``key`` in order; none before ``upto`` will follow."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class TrailingMean(InOrder):
    """Exact trailing mean per key; the past is the last ``width`` of (time, value) pairs."""

    fields = "clock_us long, event_id long, value double"

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "t long, v double")

    def take(self, key, rows: list[tuple], upto: int) -> pd.DataFrame:
        old = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        t = np.array([r[0] for r in old] + [r[0] for r in rows])
        v = np.array([r[1] for r in old] + [r[2] for r in rows], float)
        lo, hi = np.searchsorted(t, t - self.width, "right"), np.searchsorted(t, t, "right")
        means = [float(v[a:b].mean()) for a, b in zip(lo[len(old) :], hi[len(old) :])]
        keep = int(np.searchsorted(t, upto - self.width, "right"))
        if keep < len(t):
            self.recent.put(list(zip(t[keep:].tolist(), v[keep:].tolist())))
        else:
            self.recent.clear()
        return pd.DataFrame({"event_id": [r[1] for r in rows], "mean": means})


class Possession(InOrder):
    """Ball losses: the other side takes the ball with ``touches`` touches in a row; the holder's own touch breaks the row."""

    fields = "clock_us long, event_id long, team int"

    def __init__(self, touches: int = 1):
        self.touches = touches

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "team int, streak int")

    def take(self, key, rows: list[tuple], upto: int) -> pd.DataFrame:
        holder, streak = self.last.get() if self.last.exists() else (None, 0)
        lost = []
        for _, event, team in rows:
            if holder is None:
                holder = team
            streak = 0 if team == holder else streak + 1
            if streak >= self.touches:
                lost.append((key[0], event, holder))
                holder, streak = team, 0
        self.last.update((holder, streak))
        return pd.DataFrame(lost, columns=["match_id", "event_id", "loser"])


class PressureStep(InOrder):
    """Reaction-time position of each reading, from the key's reading before it."""

    fields = "clock_us long, event_id long, x double, y double"

    def __init__(self, lookback: int):
        self.lookback = lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.was = handle.getValueState("was", "t long, x double, y double")

    def take(self, key, rows: list[tuple], upto: int) -> pd.DataFrame:
        was, out = (tuple(self.was.get()) if self.was.exists() else None), []
        for t, event, x, y in rows:
            out.append((event, *reached(was, (t, x, y), self.lookback)))
            was = (t, x, y)
        self.was.update(was)
        return pd.DataFrame(out, columns=["event_id", "rx", "ry"])


#: Seconds of reaction, running speed, and centre and width of the curve from arrival time to pressure.
REACTION, SPEED, CENTRE, WIDTH = 0.7, 8.0, 1.5, 0.5
#: Two readings a microsecond apart give a velocity whose exponential is no number; from here on the curve is below 1e-300.
FAR = 700.0


def reached(was: tuple | None, now: tuple, lookback: int) -> tuple[float, float]:
    """Where a player is after the reaction time at the velocity since the reading ``was``, if that is recent enough."""
    t, x, y = now
    if was is None or not 0 < t - was[0] <= lookback:
        return x, y
    dt = (t - was[0]) / 1e6
    return x + REACTION * (x - was[1]) / dt, y + REACTION * (y - was[2]) / dt


class PressureFrames(InOrder):
    """Pressure on a point per side and frame, and who presses most.

    Every entity of a side has its latest reading in state, as long as it is recent enough to give a velocity. A frame is
    worked out once the watermark has passed its end.
    """

    fields = "clock_us long, event_id long, entity long, x double, y double"

    def __init__(self, frame: int, lookback: int):
        self.step, self.lookback = frame, lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.was = handle.getMapState("was", "entity long", "t long, x double, y double")

    def take(self, key, rows: list[tuple], upto: int) -> pd.DataFrame:
        was = {k[0]: tuple(v) for k, v in self.was.iterator()} if self.was.exists() else {}
        frames: dict[int, list[tuple[float, int]]] = {}
        before = dict(was)
        for t, _, entity, x, y in rows:
            rx, ry = reached(was.get(entity), (t, x, y), self.lookback)
            chance = 1 / (1 + math.exp(min((REACTION + math.hypot(rx, ry) / SPEED - CENTRE) / WIDTH, FAR)))
            frames.setdefault(t // self.step, []).append((-round(chance, 6), entity, chance))
            was[entity] = (t, x, y)
        for entity, at in was.items():
            if at[0] < upto - self.lookback:
                if entity in before:
                    self.was.removeKey((entity,))
            elif before.get(entity) != at:
                self.was.updateValue((entity,), at)
        out = [(*key, f, len(c), 1 - math.prod(1 - x[2] for x in c), min(c)[1]) for f, c in frames.items()]
        return pd.DataFrame(out, columns=["match_id", "team", "frame", "n", "score", "presser"])


class LateRows(StatefulProcessor):
    """Rows that come more than ``delay`` after a row of their key from an earlier micro-batch, and how late they are."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.front = handle.getValueState("front", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        front = self.front.get()[0] if self.front.exists() else None
        highest = front
        for part in rows:
            top = int(part["clock_us"].max())
            highest = top if highest is None else max(highest, top)
            if front is not None:
                late = part[part["clock_us"] < front - self.delay]
                if len(late):
                    yield pd.DataFrame({"match_id": late["match_id"], "event_id": late["event_id"], "late_us": front - late["clock_us"]})
        self.front.update((highest,))

    def close(self) -> None:
        pass


def in_order(s: DataFrame, keys: list[str], processor: InOrder, schema: str, delay: str) -> DataFrame:
    """``processor`` per key, in event time; rows without the first key only move the watermark (see :func:`closing`)."""
    held = s.withWatermark("ts", delay).where(F.col(keys[0]).isNotNull() | F.col("ts").isNull())  # reads ts, so stays above the watermark
    return held.groupBy(*keys).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime")


def closing(rows: DataFrame, key: str, after: str = "1 day") -> DataFrame:
    """One row long after all others and without a key: read last, it lets every window, session and timer end."""
    end = rows.agg(F.max("ts").alias("ts"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("ts", key)]
    return end.select((F.col("ts") + F.expr(f"INTERVAL {after}")).alias("ts"), F.lit(None).cast(rows.schema[key].dataType).alias(key), *empty).select(*rows.columns)


def stateful(s: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return s.groupBy(*keys).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="None")
