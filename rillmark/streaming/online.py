"""Online event detection: an addition to the batch operators, not a part of the batch results."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillmark.operators import events


def snapped(stream: DataFrame, key: str, ts: str, value: str, step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Mean value by key and step; readings later than `late` are given up."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, step), key).agg(F.avg(value).alias("value")).select(key, F.col("window.end").alias("ts"), "value")


def sessions(stream: DataFrame, key: str, ts: str, value: str, threshold: float, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of readings above the threshold, by key: they end after `gap` without one."""
    high = stream.withWatermark(ts, late).where(F.col(value) > threshold)
    out = high.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "peak")


class _Consensus(StatefulProcessor):
    """Of one site: readings that may still change a slot, sensors' rises of the event that is open, and how far slots are decided.

    A slot is decided when the watermark has passed all that its rise can depend on: the window of the mean, one slot more,
    and the longest gap that is filled. State holds a few slots of each sensor and the open event, whatever the stream's length.
    """

    def __init__(self, sensor: str, ts: str, value: str, origin: str, config: events.Detector):
        self.names, self.origin, self.config = (sensor, ts, value), pd.Timestamp(origin), config
        self.half = max(1, round(config.smooth_minutes * 60 / config.step)) // 2
        self.reach = self.half + 1 + config.max_gap + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "json string")

    def _state(self) -> dict:
        if self.held.exists():
            return json.loads(self.held.get()[0])
        return {"decided": None, "values": {}, "high": [], "open": None}

    def _slot(self, seconds: float) -> int:
        return math.ceil(round(seconds / self.config.step, 9))

    def handleInputRows(self, key, rows, timerValues):
        state = self._state()
        for batch in rows:
            sensor, ts, value = (batch[c] for c in self.names)
            since = (ts.dt.tz_localize(None) - self.origin).dt.total_seconds()
            for k, at, v in zip(sensor, since, value, strict=True):
                slot = self._slot(at)
                if pd.notna(v) and (state["decided"] is None or slot > state["decided"] - self.reach):
                    own = state["values"].setdefault(k, {})
                    if str(slot) not in own or own[str(slot)][0] <= at:  # the last reading of a slot counts
                        own[str(slot)] = [at, float(v)]
        yield from self._decided(key, state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._decided(key, self._state(), timerValues.getCurrentWatermarkInMs())

    def _filled(self, own: dict[str, list], low: int, high: int) -> dict[int, float]:
        """Values of slots from low to high, straight lines over short gaps."""
        known = sorted((int(s), v) for s, (_, v) in own.items())
        out = dict(known)
        for (a, u), (b, w) in zip(known, known[1:], strict=False):
            if 1 < b - a <= self.config.max_gap + 1:
                out |= {s: u + (w - u) * (s - a) / (b - a) for s in range(a + 1, b)}
        return {s: v for s, v in out.items() if low <= s <= high}

    def _decided(self, key, state: dict, watermark_ms: int):
        """Decides the slots that the watermark allows; gives the events that end by them."""
        config, out = self.config, []
        until = math.floor((watermark_ms / 1000 - self.origin.timestamp()) / config.step) - self.reach
        first = min((int(s) for own in state["values"].values() for s in own), default=None)
        start = state["decided"] + 1 if state["decided"] is not None else first
        if start is not None and until >= start:
            width = 2 * self.half + 1
            rises: dict[int, list] = {}
            for sensor, own in state["values"].items():
                filled = self._filled(own, start - self.reach, until + self.reach)
                mean = {}
                for s in range(start - 1, until + 2):
                    window = [filled.get(q) for q in range(s - self.half, s + self.half + 1)]
                    if None not in window:
                        mean[s] = sum(window) / width
                for s in range(start, until + 1):
                    if s - 1 in mean and s + 1 in mean:
                        rise = (mean[s + 1] - mean[s - 1]) / (2 * config.step / 3600)
                        if rise > config.threshold:
                            rises.setdefault(s, []).append([s, sensor, rise])
            gap, least = config.gap_minutes * 60 // config.step, config.min_minutes * 60 // config.step
            for s in range(start, until + 1):
                state["high"] += rises.get(s, [])
                if len(rises.get(s, [])) >= config.sensors:
                    if state["open"] and s - (state["open"][1] + 1) > gap:
                        out += self._closed(state, least)
                        state["high"] = rises[s][:]
                    state["open"] = [state["open"][0], s] if state["open"] else [s, s]
                elif state["open"] is None:
                    state["high"] = []
            if state["open"] and until - state["open"][1] > gap:
                out += self._closed(state, least)
            state["decided"] = until
            keep = until + 1 - self.reach - config.max_gap - 1
            state["values"] = {k: {s: v for s, v in own.items() if int(s) >= keep} for k, own in state["values"].items()}
        self.held.update((json.dumps(state),))
        if state["values"] or state["open"]:
            ahead = max([until + 1, *(int(s) for own in state["values"].values() for s in own), (state["open"] or [0, 0])[1] + config.gap_minutes * 60 // config.step + 1])
            for s in {until + 1, ahead}:  # the next slot that can be decided, and the one by which all will be
                self.handle.registerTimer(int((self.origin.timestamp() + (s + self.reach) * config.step) * 1000))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["site", "start", "end", "peak_dvwc", "n_responding", "peak_time", "sensors_responding"])

    def _closed(self, state: dict, least: int) -> list[tuple]:
        (s, last), state["open"] = state["open"], None
        inside = [h for h in state["high"] if s <= h[0] <= last]
        state["high"] = []
        if last + 1 - s < least:
            return []
        at = lambda slot: self.origin + pd.Timedelta(seconds=slot * self.config.step)
        peak = max(inside, key=lambda h: (h[2], -h[0]))
        names = sorted({h[1] for h in inside})
        return [(at(s), at(last + 1), peak[2], len(names), at(peak[0]), ";".join(names))]

    def close(self) -> None:
        pass


def detected(stream: DataFrame, site: str, sensor: str, ts: str, value: str, origin: str, config: events.Detector | None = None, late: str = "1 hour") -> DataFrame:
    """Events by consensus of each site's sensors, as events.detect finds them, each given once it has ended.

    (site, start, end, peak_dvwc, n_responding, peak_time, sensors_responding). Slots count from `origin`; readings later
    than `late` may be lost. Needs the RocksDB state store. An event ends with the first slot after it, also at the stream's end.
    """
    rows = stream.select(F.col(site).cast("string").alias("site"), F.col(sensor).cast("string").alias("sensor"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    schema = "site string, start timestamp_ntz, end timestamp_ntz, peak_dvwc double, n_responding bigint, peak_time timestamp_ntz, sensors_responding string"
    processor = _Consensus("sensor", "ts", "value", origin, config or events.Detector())
    return rows.withWatermark("ts", late).groupBy("site").transformWithStateInPandas(processor, schema, "Append", "EventTime")
