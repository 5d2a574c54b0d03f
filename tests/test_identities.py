"""Identities by speculative chunks against a plain scan."""

import random

import numpy as np
import pytest

from kinetable.operators import tracking as T

JOINTS, RADIUS = 3, 5.0


def plain(rows, expire, confidence=0.1, least=0.5):
    frames = {}
    for s, f, p, j, x, y, c in rows:
        frames.setdefault((s, f), {}).setdefault(p, np.zeros((JOINTS, 3)))[j] = (x, y, c)
    out, session = {}, None
    for s, f in sorted(frames):
        if s != session:
            session, tracks, opened = s, {}, 0
        tracks = {t: v for t, v in tracks.items() if f - v[1] <= expire + 1}
        options = []
        for p, now in frames[s, f].items():
            for t, (old, last, as_) in tracks.items():
                both = (now[:, 2] >= confidence) & (old[:, 2] >= confidence)
                d = np.where(both, np.hypot(now[:, 0] - old[:, 0], now[:, 1] - old[:, 1]), 0.0)
                if both.any() and (both & (d < RADIUS)).sum() / both.sum() >= least:
                    options.append((-(both & (d < RADIUS)).sum() / both.sum(), d.sum(), p, -last, as_, t))
        got = {}
        for *_, p, _, _, t in sorted(options):
            if p not in got and t not in got.values():
                got[p] = t
        for p in sorted(frames[s, f]):
            if p not in got:
                got[p], opened = opened, opened + 1
            out[s, f, p] = got[p]
            tracks[got[p]] = (frames[s, f][p], f, p)
    return out


def crowd(seed, sessions=3, frames=160):
    """People who walk among each other and come and go."""
    rng, out = random.Random(seed), []
    for s in range(sessions):
        at = [[rng.uniform(0, 12), rng.uniform(0, 12)] for _ in range(4)]
        f = 0
        for _ in range(frames):
            f += rng.choice([1] * 30 + [2, 5, 20])
            p = 0
            for xy in at:
                xy[0] += rng.uniform(-2, 2)
                xy[1] += rng.uniform(-2, 2)
                if rng.random() < 0.7:
                    out += [(s, f, p, j, xy[0] + j, xy[1] - j, rng.choice([0.0, 0.5, 0.9])) for j in range(JOINTS)]
                    p += 1
    return out


@pytest.mark.parametrize("seed,span,warm", [(1, 1024, 3), (2, 12, 3), (3, 8, 1), (4, 8, 1)])
def test_against_a_plain_scan(spark, monkeypatch, seed, span, warm):
    """Short chunks that start late disagree often; the rounds end with the numbers of the plain scan."""
    monkeypatch.setattr(T, "SPAN", span)
    monkeypatch.setattr(T, "WARM", warm)
    disagreeing, write = [], T.written

    def noted(df, name):
        out = write(df, name)
        if name == "disagreeing":
            disagreeing.append(out.count())
        return out

    monkeypatch.setattr(T, "written", noted)
    rows = crowd(seed)
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, person_idx int, joint int, x double, y double, c double").repartition(4)
    got = T.link_track_ids(df, JOINTS, RADIUS, expire=2).collect()
    assert {(r.session_id, r.frame_idx, r.person_idx): r.track_id for r in got} == plain(rows, 2)
    assert disagreeing[-1] == 0 and (warm > 1 or sum(disagreeing) > 0)


def test_long_tracks_over_many_chunks(spark, monkeypatch):
    """One person seen in every frame is one track."""
    monkeypatch.setattr(T, "SPAN", 40)
    rows = [(1, f, 0, j, float(j), 0.0, 1.0) for f in range(1000) for j in range(JOINTS)]
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, person_idx int, joint int, x double, y double, c double")
    got = T.link_track_ids(df, JOINTS, RADIUS).collect()
    assert len(got) == 1000 and {r.track_id for r in got} == {0}


def test_nobody(spark):
    df = spark.createDataFrame([], "session_id long, frame_idx long, person_idx int, joint int, x double, y double, c double")
    assert T.link_track_ids(df, JOINTS, RADIUS).count() == 0


def test_a_frame_is_matched_at_once(monkeypatch):
    """All live tracks are measured against all people together; the work of a frame is not a round of calls per track."""
    calls, hypot = [], np.hypot
    monkeypatch.setattr(T.np, "hypot", lambda *a: calls.append(1) or hypot(*a))
    tracks = T._Tracks(30.0, 0.1, 0.5, 10)
    person = lambda at: np.stack([np.full(3, at), np.arange(3.0), np.ones(3)], axis=1)
    assert tracks.meet(0, [(p, person(100.0 * p)) for p in range(4)]) == [(p, p, True) for p in range(4)]
    assert tracks.meet(1, [(p, person(100.0 * (3 - p) + 2)) for p in range(4)]) == [(p, 3 - p, False) for p in range(4)]
    assert tracks.meet(2, [(0, person(1000.0)), (1, person(101.0))]) == [(0, 4, True), (1, 1, False)]
    assert len(calls) == 2
