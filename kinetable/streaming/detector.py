"""Live fall detection: keyed state per session."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import RuleConfig
from .rule import SIGNALS, Frame, LiveRule, Memory, forced, released

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = (
    "session_id bigint, frame_idx bigint, state string, fall_latched boolean, calibrating boolean, detected boolean, "
    "score double, downward_speed double, drop double, torso_angle double, bbox_aspect double, low_hip double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
PROBE_FRAMES = 15
LATE = "LATE"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class LiveConfig:
    frame_height: int = 480
    fps: float | None = None  # None: measured on the first frames of the session
    fallback_fps: float = 10.0
    rule: RuleConfig = RuleConfig()
    calibration_seconds: float = 2.0
    auto_clear_seconds: float = 0.0
    fall_hold_seconds: float = 0.0
    idle_ms: int | None = None  # forget sessions idle this long; a live setting, it keeps the query awake


def probe_fps(times: list[float], fallback: float) -> float:
    """1 / median interval of the probe, clipped to [1, 60]."""
    gaps = sorted(b - a for a, b in zip(times, times[1:]) if 0.001 < b - a < 2.0)
    if len(times) < 5 or not gaps:
        return fallback
    n = len(gaps)
    mid = (gaps[(n - 1) // 2] + gaps[n // 2]) / 2
    return min(max(1.0 / mid, 1.0), 60.0)


def records(batch: pd.DataFrame) -> list[dict]:
    """Rows as dicts, unknown values as None, column by column: a session's rows are few, so what a data frame costs by itself counts."""
    columns = [[None if v is None or v != v else v for v in batch[c].tolist()] for c in batch.columns]
    return [dict(zip(batch.columns, values)) for values in zip(*columns)]


def place(row: dict) -> tuple:
    """Commands come after the frame of the same index, rows without an index last."""
    at = row["frame_idx"]
    return at is None, at or 0, row["control"] is not None


def table(out: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: [r.get(c) for r in out] for c in COLUMNS})


class FallProcessor(StatefulProcessor):
    """One value per session: the rule's memory, or the probe buffer before it starts.

    Rows are frames (``control`` NULL) and commands that take effect after the frame of the same index: ``force`` and
    ``reset`` the alarm, ``end`` the session.  A session that ends (by command, or by the idle timer) before its rate
    could be measured is decided at the rate that its few frames tell, else at the fallback rate; nothing is lost.
    Frames that come after later ones were decided are given out as they are, with state LATE, and change nothing.
    """

    def __init__(self, config: LiveConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "fps double, height double, buffer string, machine string, newest bigint")

    def _load(self):
        return self.memory.get() if self.memory.exists() else (None, None, "[]", None, -1)

    def _decide(self, key, fps: float, height: float, memory: str | None, newest: int, queue: list[dict]):
        c = self.config
        rule = LiveRule(fps, height, c.rule, c.calibration_seconds, c.auto_clear_seconds, c.fall_hold_seconds)
        m, out = Memory.load(memory) if memory else Memory(), []
        for r in queue:
            if r["control"] == "force":
                m = forced(m)
            elif r["control"] == "reset":
                m = released(m)
            elif r["control"] is None and r["frame_idx"] <= newest:
                out.append({"session_id": key[0], "frame_idx": r["frame_idx"], "state": LATE, "fall_latched": m.alarmed, "detected": bool(r["detected"])})
            elif r["control"] is None:
                m, got = rule.step(m, Frame(bool(r["detected"]), {s: r[s] for s in SIGNALS}, r["body_height"]))
                out.append({"session_id": key[0], "frame_idx": r["frame_idx"], **got})
                newest = r["frame_idx"]
        return m.dump(), newest, out

    def _height(self, height: float | None, queue: list[dict]) -> float:
        return height or next((r["frame_height"] for r in queue if r["frame_height"]), None) or self.config.frame_height

    def _rate(self, queue: list[dict], ended: bool) -> float | None:
        """The rate that the session's rows or the settings name; else that of the first frames, once there are enough."""
        named = next((r["fps"] for r in queue if r["fps"]), None) or self.config.fps
        if named:
            return named
        times = [r["seconds"] for r in queue if r["control"] is None]
        if len(times) >= PROBE_FRAMES or ended:
            return probe_fps(times[:PROBE_FRAMES], self.config.fallback_fps)
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fps, height, buffer, memory, newest = self._load()
        queue = json.loads(buffer) + sorted((r for b in rows for r in records(b)), key=place)
        ended = any(r["control"] == "end" for r in queue)
        fps, height, out = fps or self._rate(queue, ended), self._height(height, queue), []
        if fps is not None:
            memory, newest, out = self._decide(key, fps, height, memory, newest, queue)
            queue = []
        if ended:
            self.memory.clear()
        else:
            self.memory.update((fps, float(height), json.dumps(queue), memory, newest))
        if self.config.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.config.idle_ms)
        yield table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fps, height, buffer, memory, newest = self._load()
        queue = json.loads(buffer)
        self.memory.clear()
        out = self._decide(key, fps or self._rate(queue, True), self._height(height, queue), memory, newest, queue)[2] if queue else []
        yield table(out)

    def close(self) -> None:
        pass


INPUT_COLUMNS = ("session_id", "frame_idx", "seconds", "detected", *SIGNALS, "body_height", "control")
#: What a session may say of itself; the settings hold where it doesn't.
OWN_COLUMNS = ("fps", "frame_height")


def detect_stream(frames: DataFrame, config: LiveConfig) -> DataFrame:
    """Decisions for a stream of frame geometry (``INPUT_COLUMNS``, ``OWN_COLUMNS`` if there are any), optionally unioned with commands."""
    use_rocksdb(frames.sparkSession)
    own = [(F.col(c) if c in frames.columns else F.lit(None)).cast("double").alias(c) for c in OWN_COLUMNS]
    return (
        frames.select(*INPUT_COLUMNS, *own)
        .groupBy("session_id")
        .transformWithStateInPandas(
            FallProcessor(config), OUTPUT, "append", "none" if config.idle_ms is None else "processingTime"
        )
    )
