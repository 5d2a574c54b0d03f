"""The live fall rule as transitions: (memory, frame) -> (memory, decision), without side effects.

A memory is a small record of plain values; it goes into a state store as JSON.  Smoothing and thresholds are
those of ``operators.causal`` and ``operators.detect``; this module adds what only a live detector has: alarm
commands and the releases of a latched alarm.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from statistics import median

from ..functions.columns import frames, py_round
from ..operators.detect import FALL_CANDIDATE, FALLEN, FALLING, NORMAL, UNKNOWN, RuleConfig

SIGNALS = ("head_y", "hip_y", "torso_angle", "bbox_aspect")

# Spans in seconds, and shares of the frame height that stand in for a body not measured.
HELD, SMOOTHED, SPEED, DROP, AWAY = 0.3, 0.15, 0.4, 1.0, 0.5
LEAST_BODY, DEFAULT_HIP = 0.15, 0.5


@dataclass(frozen=True)
class Track:
    """One signal: its last value with its age, the held values of the smoothing, the smoothed values of the longest span."""

    last: float | None = None
    age: int = 0
    held: tuple = ()
    smooth: tuple = ()


@dataclass(frozen=True)
class Memory:
    frame: int = -1
    state: str = UNKNOWN
    alarm_since: int | None = None
    first_alarm: int | None = None
    evidence_until: int = -1
    lying: int = 0
    lost: int = 0
    upright: int = 0
    away: int = 0
    body: float | None = None
    hip: float | None = None
    bodies: tuple = ()
    hips: tuple = ()
    tracks: dict = field(default_factory=lambda: {s: Track() for s in SIGNALS})

    @property
    def alarmed(self) -> bool:
        return self.alarm_since is not None

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> "Memory":
        raw = json.loads(text)
        tracks = {s: Track(t["last"], t["age"], tuple(t["held"]), tuple(t["smooth"])) for s, t in raw.pop("tracks").items()}
        return Memory(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}, tracks=tracks)


@dataclass(frozen=True)
class Frame:
    detected: bool
    signals: dict
    body_height: float | None


@dataclass(frozen=True)
class Measures:
    speed: float = 0.0
    drop: float = 0.0
    angle: float = 0.0
    aspect: float = 0.0
    low_hip: float = 0.0


def confirmed(m: Memory) -> Memory:
    """The alarm is on from this frame; a confirmation while it is on renews it."""
    return replace(m, state=FALLEN, alarm_since=m.frame, first_alarm=m.frame if m.first_alarm is None else m.first_alarm)


def forced(m: Memory) -> Memory:
    return replace(confirmed(m), upright=0)


def released(m: Memory) -> Memory:
    """No alarm and nothing left of what led to it; the baseline and the first alarm stay."""
    start = Memory()
    cleared = {name: getattr(start, name) for name in ("alarm_since", "evidence_until", "lying", "lost", "upright", "away")}
    return replace(m, state=NORMAL, **cleared)


def _difference(values: tuple, back: int) -> float | None:
    if len(values) <= back:
        return None
    new, old = values[-1], values[-1 - back]
    return None if new is None or old is None else new - old


def _greatest(values: Iterable[float | None]) -> float:
    return max((v for v in values if v is not None), default=0.0)


class LiveRule:
    """The rule at one frame rate."""

    def __init__(
        self, fps: float, frame_height: int, config: RuleConfig | None = None, calibration_seconds: float = 2.0,
        auto_clear_seconds: float = 0.0, fall_hold_seconds: float = 0.0,
    ) -> None:
        if not fps > 0:
            raise ValueError(f"a frame rate above 0 is needed, not {fps}")
        self.fps, self.height, self.config = float(fps), frame_height, config or RuleConfig()
        self.calibration_seconds = calibration_seconds
        self.spans: dict[float, int] = {}
        # releases are off at 0 seconds
        self.clear_frames = py_round(fps * max(0.0, auto_clear_seconds))
        self.hold_frames = py_round(fps * max(0.0, fall_hold_seconds))

    def span(self, seconds: float) -> int:
        if seconds not in self.spans:
            self.spans[seconds] = frames(self.fps, seconds)
        return self.spans[seconds]

    def step(self, m: Memory, frame: Frame) -> tuple[Memory, dict]:
        m = replace(m, frame=m.frame + 1, tracks={s: self.tracked(m.tracks[s], frame.signals[s]) for s in SIGNALS})
        live = m.body is not None
        measures = self.measured(m)
        if live:
            m = self.decided(m, measures, frame.detected)
        else:
            m = self.calibrated(m, frame.body_height)
        return m, {
            "state": m.state, "fall_latched": m.alarmed, "calibrating": m.body is None, "detected": frame.detected,
            "score": self.score(measures) if m.body is not None else 0.0, "downward_speed": measures.speed, "drop": measures.drop,
            "torso_angle": measures.angle, "bbox_aspect": measures.aspect, "low_hip": measures.low_hip,
        }

    def tracked(self, t: Track, value: float | None) -> Track:
        """Values are held over short gaps; the median of the latest held values is the smooth one."""
        age = t.age + 1 if value is None else 0
        last = t.last if value is None else value
        held = (*t.held, last if age <= self.span(HELD) else None)[-1 - self.span(SMOOTHED):]
        known = [v for v in held if v is not None]
        longest = max(self.span(SPEED), self.span(DROP))
        return Track(last, age, held, (*t.smooth, median(known) if known else None)[-1 - longest:])

    def measured(self, m: Memory) -> Measures:
        """What the rule looks at; without a baseline only posture is known."""
        now = {s: t.smooth[-1] for s, t in m.tracks.items()}
        angle, aspect = now["torso_angle"] or 0.0, now["bbox_aspect"] or 0.0
        if m.body is None:
            return Measures(angle=angle, aspect=aspect)

        def fall(seconds: float) -> list[float | None]:
            differences = [_difference(m.tracks[s].smooth, self.span(seconds)) for s in ("hip_y", "head_y")]
            return [None if d is None else d / m.body for d in differences]

        rate = self.fps / self.span(SPEED)
        speed = _greatest(None if d is None else d * rate for d in fall(SPEED))
        hip = now["hip_y"]
        return Measures(speed, _greatest(fall(DROP)), angle, aspect, 0.0 if hip is None else (hip - m.hip) / m.body)

    def calibrated(self, m: Memory, body: float | None) -> Memory:
        """The baseline is fixed once the opening seconds are over and a body was seen."""
        hip = m.tracks["hip_y"].smooth[-1]
        bodies = m.bodies if body is None else (*m.bodies, body)
        hips = m.hips if hip is None else (*m.hips, hip)
        if not bodies or m.frame < self.span(self.calibration_seconds) - 1:
            return replace(m, bodies=bodies, hips=hips)
        return replace(
            m, state=NORMAL, bodies=(), hips=(), body=max(median(bodies), LEAST_BODY * self.height),
            hip=median(hips) if hips else DEFAULT_HIP * self.height,
        )

    def decided(self, m: Memory, x: Measures, seen: bool) -> Memory:
        c = self.config
        moves = x.drop >= c.min_drop and x.speed >= c.min_downward_speed
        lies_flat = x.aspect >= c.min_bbox_aspect or x.angle >= c.min_torso_angle
        is_low = x.low_hip >= c.min_low_hip
        if moves:
            m = replace(m, evidence_until=m.frame + self.span(c.evidence_window_seconds))
        m = replace(m, away=0 if seen else m.away + 1)
        recent = m.frame <= m.evidence_until
        lying = recent and seen and lies_flat and is_low
        m = self.counted(m, recent, lying, seen)
        if m.state != FALLEN:
            m = replace(m, state=self.open_state(m, moves, recent, lying, seen))
        enough = m.lying >= self.span(c.confirmation_seconds) or m.lost >= self.span(c.missing_confirmation_seconds)
        if recent and enough:
            m = confirmed(m)
        return self.after_releases(m, stands=seen and not (lies_flat or is_low))

    @staticmethod
    def counted(m: Memory, recent: bool, lying: bool, seen: bool) -> Memory:
        """Lying frames count up and other seen ones down; frames without a person count as lost. A fall freezes both outside evidence."""
        fallen = m.state == FALLEN
        if not recent:
            return m if fallen else replace(m, lying=0, lost=0)
        change = 1 if lying else -1 if seen and not fallen else 0
        return replace(m, lying=max(0, m.lying + change), lost=0 if seen else m.lost + 1)

    def open_state(self, m: Memory, moves: bool, recent: bool, lying: bool, seen: bool) -> str:
        """State of a frame that no fall has reached: the strongest sign, else what was."""
        if lying:
            return FALL_CANDIDATE
        if moves:
            return FALLING
        if recent:
            return m.state
        if seen:
            return NORMAL
        return UNKNOWN if m.away >= self.span(AWAY) else m.state

    def after_releases(self, m: Memory, stands: bool) -> Memory:
        """An alarm ends when the person has stood long enough or its time is over."""
        if self.clear_frames and m.alarmed:
            m = replace(m, upright=m.upright + 1 if stands else 0)
            m = released(m) if m.upright >= self.clear_frames else m
        if self.hold_frames and m.alarmed and m.frame >= m.alarm_since + self.hold_frames:
            m = released(m)
        return m

    def score(self, x: Measures) -> float:
        c = self.config
        parts = (
            (x.speed, c.min_downward_speed, 0.35), (x.drop, c.min_drop, 0.25), (x.angle, c.min_torso_angle, 0.15),
            (x.aspect, c.min_bbox_aspect, 0.10), (max(x.low_hip, 0.0), c.min_low_hip, 0.15),
        )
        return sum(weight * min(value / limit, 2.0) for value, limit, weight in parts)
