"""Identity linking, by speculative scans of chunks, and the releasing alarm latch, an automaton."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written
from . import automata
from .chunks import running_last, running_sum

EXPIRE = 10
#: Frames that a task scans, and times that a track can be out of sight for which it starts early.
SPAN, WARM = 1024, 3


def match_radius(width: int, height: int, distance: float = 30.0) -> float:
    return max(10.0, distance * (width * height) ** 0.5 / 960.0)


def track_pair_scores(
    people: DataFrame, previous: DataFrame, radius: float, confidence: float = 0.1, least: float = 0.5, frame: Sequence[str] = ("session_id", "frame_idx"),
) -> DataFrame:
    """Share of common joints within ``radius`` for pairs of people that reach ``least``.

    Close joints are found by an equi-join on image cells; only pairs with at least one of them
    are measured, so the people of a frame are not all paired.  Cells are four times the radius wide: a
    joint of the frame before has its surroundings in one or two a side, so it is copied 2.25 times in the mean.
    ``frame`` identifies the frame.
    """
    frame, cell = list(frame), 4 * radius
    cur = people.where(F.col("c") >= confidence).select(*frame, "joint", F.col("person_idx").alias("person_a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    old = previous.where(F.col("c") >= confidence).select(*frame, "joint", F.col("person_idx").alias("person_b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell)))
    near = (
        cur.withColumns({"_cx": F.floor(F.col("ax") / cell), "_cy": F.floor(F.col("ay") / cell)})
        .join(old.withColumn("_cx", around("bx")).withColumn("_cy", around("by")), [*frame, "joint", "_cx", "_cy"])
        .where(d < radius)
        .groupBy(*frame, "person_a", "person_b")
        .agg(F.count("*").alias("inliers"))
    )
    measured = (
        near.join(cur, [*frame, "person_a"]).join(old, [*frame, "person_b", "joint"])
        .groupBy(*frame, "person_a", "person_b", "inliers")
        .agg(F.count("*").alias("active"), F.sum(d).alias("distance"))
    )
    return measured.withColumn("score", F.col("inliers") / F.col("active")).where(F.col("score") >= least)


class _Tracks:
    """Live tracks of a scan: last joints, which were seen, and when and as whom the track was last met."""

    def __init__(self, radius: float, confidence: float, least: float, expire: int) -> None:
        self.live: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}
        self.radius, self.confidence, self.least, self.expire = radius, confidence, least, expire
        self.opened = 0

    def meet(self, frame: int, people: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, bool]]:
        """(person, track, whether it is new) of a frame's people: best share of close joints first, then the nearest,
        one to one.  Nothing depends on the tracks' numbers, so scans with the same live tracks go on alike."""
        self.forget(frame)
        kps = np.stack([k for _, k in people])
        seen = kps[..., 2] >= self.confidence
        options = []
        if self.live:  # all tracks against all people at once; a frame has few of both
            xy, ok, last, as_ = zip(*self.live.values(), strict=True)
            track, old = list(self.live), np.stack(xy)[:, None]
            both = np.stack(ok)[:, None] & seen
            active = both.sum(axis=2)
            dist = np.where(both, np.hypot(kps[..., 0] - old[..., 0], kps[..., 1] - old[..., 1]), 0.0)
            close = (both & (dist < self.radius)).sum(axis=2).tolist()
            total, met = dist.sum(axis=2).tolist(), active.tolist()
            for t, p in np.argwhere(active).tolist():
                share = close[t][p] / met[t][p]
                if share >= self.least:
                    options.append((-share, total[t][p], p, -last[t], as_[t], track[t]))
        taken: dict[int, int] = {}
        used = set()
        for *_, p, _, _, track in sorted(options):
            if p not in taken and track not in used:
                taken[p] = track
                used.add(track)
        out = []
        for p, (person, _) in enumerate(people):
            track = taken.get(p, self.opened)
            self.opened += p not in taken
            self.live[track] = (kps[p, :, :2], seen[p], frame, person)
            out.append((person, track, p not in taken))
        return out

    def forget(self, frame: int) -> None:
        for t in [t for t, v in self.live.items() if frame - v[2] > self.expire + 1]:
            del self.live[t]

    def carry(self, frame: int, people: list[tuple[int, np.ndarray]], wanted: set) -> None:
        """Tracks that were last met at this frame, as a scan before has left them."""
        for person, k in people:
            if (frame, person) in wanted:
                self.live[self.opened] = (k[:, :2], k[:, 2] >= self.confidence, frame, person)
                self.opened += 1

    def sightings(self, border: int) -> list[tuple[int, int, int]]:
        """(frame, person, track) of the tracks that can still be met from ``border`` on."""
        self.forget(border)
        return sorted((last, person, t) for t, (_, _, last, person) in self.live.items())


SCANNED = "session_id bigint, chunk bigint, kind string, frame_idx bigint, person_idx int, local bigint, is_new boolean"


def _scan(joints: int, radius: float, confidence: float, least: float, expire: int, span: int):
    """Rows sorted by session, chunk, frame and person to ``SCANNED``; holds a frame and the live tracks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, frame, early, wanted, people, tracks, out = None, None, True, None, [], None, []

        def border(kind: str, at: int) -> None:
            out.extend((*key, kind, f, p, t, False) for f, p, t in tracks.sightings(at))

        def close_frame() -> None:
            if people and early and wanted is not None:
                tracks.carry(frame, people, wanted)
            elif people:
                met = tracks.meet(frame, people)
                if not early:
                    out.extend((*key, "row", frame, person, t, new) for person, t, new in met)
            people.clear()

        def close_chunk() -> None:
            if key is not None:
                close_frame()
                if early:
                    border("start", key[1] * span)
                border("end", (key[1] + 1) * span)

        for b in batches:
            for s, c, f, p, first, k, given in zip(b["session_id"], b["chunk"], b["frame_idx"], b["person_idx"], b["early"], b["kps"], b["given"], strict=True):
                if (s, c) != key:
                    close_chunk()
                    key, frame, early = (s, c), f, True
                    tracks = _Tracks(radius, confidence, least, expire)
                    wanted = None if given is None else {(g["f"], g["p"]) for g in given}
                if f != frame:
                    close_frame()
                    frame = f
                if early and not first:
                    close_frame()
                    early = False
                    border("start", c * span)
                people.append((p, np.asarray(k, dtype=float).reshape(joints, 3)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCANNED.split(", ")])
            out.clear()
        close_chunk()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCANNED.split(", ")])

    return run


def _borders(scanned: DataFrame) -> DataFrame:
    """(session_id, chunk, starts, ends): sets of sightings that a chunk starts from and leaves."""
    def sightings(kind: str):
        seen = F.when(F.col("kind") == kind, F.struct(F.col("frame_idx").alias("f"), F.col("person_idx").alias("p")))
        return F.array_sort(F.collect_list(seen)).alias(kind + "s")

    return scanned.groupBy("session_id", "chunk").agg(sightings("start"), sightings("end"))


def _origins(carried: DataFrame) -> DataFrame:
    """(session_id, chunk, local, of_chunk, of_local): the track of an earlier chunk, not carried itself, that each carried one goes on."""
    node, further = ["session_id", "chunk", "local"], ["session_id", "of_chunk", "of_local"]
    now = written(carried, "track-links")
    while True:
        on = now.select("session_id", F.col("chunk").alias("of_chunk"), F.col("local").alias("of_local"), F.col("of_chunk").alias("_c"), F.col("of_local").alias("_l"))
        step = now.join(on, further, "left").select(
            *node, F.coalesce("_c", "of_chunk").alias("of_chunk"), F.coalesce("_l", "of_local").alias("of_local"), F.col("_c").isNotNull().alias("moved")
        )
        step = written(step, "track-links")
        if step.where("moved").isEmpty():
            return now
        now = step.drop("moved")


def link_track_ids(
    people: DataFrame, joints: int, radius: float, confidence: float = 0.1, least: float = 0.5, expire: int = EXPIRE
) -> DataFrame:
    """Identity of every person, frame to frame, numbered by session in the order of first meeting.

    A session is scanned in chunks of ``SPAN`` frames, all at the same time.  A chunk starts from nothing some frames early, as
    tracks not met for ``expire`` + 1 frames are forgotten.  A scan goes on from the last sightings of its live tracks
    alone, so where a chunk arrives at its first own frame with the sightings that the chunk before leaves, its rows are
    right but for the numbers.  Only chunks that don't are scanned again, from what was left to them, until all agree.  Numbers
    come last: tracks that a chunk opened are counted on from the chunks before, others take that of the track they go on.

    Exact ties of share and distance go to the person first in the frame, then to the track met last.  Repeated
    (session, frame, person, joint) rows are not expected.
    """
    span, warm = SPAN, WARM * (expire + 1)
    if span <= warm:
        raise ValueError(f"SPAN must be above {warm}")
    slot = F.transform(
        F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.array(*[F.coalesce(F.try_element_at("_k", j)[n], F.lit(0.0)) for n in "xyc"])
    )
    person = people.groupBy("session_id", "frame_idx", "person_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y", "c")))).alias("_k")
    ).select("session_id", "frame_idx", "person_idx", F.flatten(slot).alias("kps"))
    own, reach = F.floor(F.col("frame_idx") / F.lit(span)), F.floor((F.col("frame_idx") + F.lit(warm)) / F.lit(span))
    person = written(person.withColumn("chunk", F.explode(F.sequence(own, reach))).withColumn("early", F.col("chunk") > own), "people")
    given_type = "array<struct<f:bigint,p:int>>"
    scan = _scan(joints, radius, confidence, least, expire, span)

    def scanned(rows: DataFrame, turn: int) -> DataFrame:
        dealt = rows.select("session_id", "chunk", "frame_idx", "person_idx", "early", "kps", "given").repartition("session_id", "chunk")
        out = dealt.sortWithinPartitions("session_id", "chunk", "frame_idx", "person_idx").mapInPandas(scan, SCANNED)
        return written(out.withColumn("turn", F.lit(turn)), "tracks")

    turns = scanned(person.withColumn("given", F.lit(None).cast(given_type)), 0)
    latest = written(turns.select("session_id", "chunk", "turn").distinct(), "turns")
    borders = written(_borders(turns), "borders")
    for turn in itertools.count(1):
        left = borders.select("session_id", (F.col("chunk") + 1).alias("chunk"), F.col("ends").alias("given"))
        empty = F.array().cast(given_type)
        wrong = borders.join(left, ["session_id", "chunk"], "left").where(F.col("starts") != F.coalesce("given", empty))
        wrong = written(wrong.select("session_id", "chunk", F.coalesce("given", empty).alias("given")), "disagreeing")
        if wrong.isEmpty():
            break
        again = scanned(person.join(wrong, ["session_id", "chunk"]), turn)
        rest = wrong.select("session_id", "chunk")
        borders = written(borders.join(rest, ["session_id", "chunk"], "left_anti").unionByName(_borders(again)), "borders")
        latest = written(latest.join(rest, ["session_id", "chunk"], "left_anti").unionByName(again.select("session_id", "chunk", "turn").distinct()), "turns")
        turns = turns.unionByName(again)
    final = turns.join(latest, ["session_id", "chunk", "turn"])

    new = final.where("kind = 'row' AND is_new").select("session_id", "chunk", "local")
    counts = new.groupBy("session_id", "chunk").agg(F.count("*").alias("_new"))
    shift = running_sum(counts, ["session_id"], "chunk", {"_upto": F.col("_new")}).select("session_id", "chunk", (F.col("_upto") - F.col("_new")).alias("_shift"))
    order = F.row_number().over(W.partitionBy("session_id", "chunk").orderBy("local")) - 1
    opened = new.withColumn("_order", order).join(shift, ["session_id", "chunk"]).select(
        "session_id", F.col("chunk").alias("of_chunk"), F.col("local").alias("of_local"), (F.col("_order") + F.col("_shift")).alias("track_id")
    )
    opened = written(opened, "opened")
    sighting = ["session_id", "frame_idx", "person_idx"]
    before = final.where("kind = 'end'").select(*sighting, (F.col("chunk") + 1).alias("chunk"), F.col("chunk").alias("of_chunk"), F.col("local").alias("of_local"))
    carried = final.where("kind = 'start'").select(*sighting, "chunk", "local").join(before, [*sighting, "chunk"]).select("session_id", "chunk", "local", "of_chunk", "of_local")
    ids = _origins(carried).join(opened, ["session_id", "of_chunk", "of_local"]).select("session_id", "chunk", "local", "track_id").unionByName(
        opened.select("session_id", F.col("of_chunk").alias("chunk"), F.col("of_local").alias("local"), "track_id")
    )
    rows = final.where("kind = 'row'").select("session_id", "chunk", "frame_idx", "person_idx", "local")
    return rows.join(ids, ["session_id", "chunk", "local"]).select("session_id", "frame_idx", "person_idx", "track_id")


def latch_with_release(df: DataFrame, confirm: Column, upright: Column, hold: int, clear: int) -> DataFrame:
    """Alarm latch per frame: set by ``confirm``, released ``hold`` frames after the last one or by
    ``clear`` consecutive upright frames; 0 switches a release off.

    Whether ``hold`` is over follows from the last confirmation alone, so the state is off, or on with the upright frames
    so far: an automaton with ``clear`` + 1 states.
    """
    marked = df.select("session_id", "frame_idx", F.coalesce(confirm, F.lit(False)).alias("_c"), F.coalesce(upright, F.lit(False)).alias("_u"))
    timed = running_last(marked, ["session_id"], "frame_idx", {"_since": F.when(F.col("_c"), F.col("frame_idx"))})
    over = F.coalesce(F.col("frame_idx") - F.col("_since") >= hold, F.lit(False)) if hold else F.lit(False)

    def step(state: int, code: int) -> int:
        confirmed, straight, expired = code & 1, code & 2, code & 4
        if not state and not confirmed:
            return 0
        so_far = max(state - 1, 0)
        if clear:
            so_far = so_far + 1 if straight else 0
        released = (clear and so_far >= clear) or expired
        return 0 if released else so_far + 1

    code = F.col("_c").cast("int") + 2 * F.col("_u").cast("int") + 4 * over.cast("int")
    states = automata.run(timed, ["session_id"], "frame_idx", code, automata.transition_table(step, 8, max(clear, 1) + 1))
    return states.select("session_id", "frame_idx", (F.col("state") > 0).alias("latched"))
