"""Streaming forms of smoothing, jersey locks and sticky activation, and windowed counts with watermarks.

State is kept by track and expires with event time, so a stream of any length holds only the tracks seen lately. Frames carry event
time as frame number at a frame rate; `with_time` makes the timestamps that watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.config import DEFAULT, Config

FPS = 30
#: Frames of a game at most: four hours.
GAME = 4 * 3600 * FPS
#: Lanes of a game's tracks, of which each has a state of its own.
LANES = 4


def event_time(ts: Column) -> Column:
    """Event time for watermarks: the tables' timestamps have no zone, and watermarks need one (UTC)."""
    return ts.cast("timestamp")


def with_time(df: DataFrame, fps: int = FPS) -> DataFrame:
    """Frames as timestamps; frame 0 is one frame after the epoch, for a row at the first watermark (the epoch) would be late."""
    return df.withColumn("ts", F.timestamp_millis(((F.col("frame_idx") + 1) * 1000 / fps).cast("long")))


def by_lane(df: DataFrame) -> GroupedData:
    """Rows by a few lanes of a game's tracks. A key costs more than its rows, and a game's tracks may be hundreds; a lane's rows still fit a worker."""
    return df.withColumn("lane", F.pmod(F.col("track_id"), F.lit(LANES))).groupBy("game_id", "lane")


def in_frames(frames: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[tuple]:
    """Rows of a key's frames in order, as tuples."""
    parts = list(frames)
    part = parts[0] if len(parts) == 1 else pd.concat(parts)
    at = np.lexsort([part[c].to_numpy() for c in reversed(order)])
    return zip(*(part[c].to_numpy()[at].tolist() for c in columns))


def smooth_stream(points: DataFrame, cfg: Config = DEFAULT, fps: int = FPS, late: str = "2 seconds") -> DataFrame:
    """Smoothed points as they come: (game_id, is_referee, track_id, frame_idx, x, y) to the same with sx, sy.

    State is each track's last smoothed point and frame, by lanes of tracks; a track's goes after the gap that resets smoothing anyway. Rows of a batch are taken
    in order of frames; a row no later than the state is late and is dropped."""
    out = "game_id int, is_referee boolean, track_id long, frame_idx long, sx double, sy double"
    fields = ("is_referee", "track_id", "last", "sx", "sy")
    until = lambda last: int((last + cfg.gap + 2) * 1000 / fps)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = {(r, t): (last, sx, sy) for r, t, last, sx, sy in zip(*state.get)} if state.exists else {}
        rows = []
        for role, track, frame, x, y in in_frames(frames, ["frame_idx"], ["is_referee", "track_id", "frame_idx", "x", "y"]):
            last, sx, sy = known.get((role, track), (None, None, None))
            if last is not None and frame <= last:
                continue
            if last is None or frame - last > cfg.gap:
                sx, sy = float(x), float(y)
            else:
                dx, dy = x - sx, y - sy
                size = (dx * dx + dy * dy) ** 0.5
                scale = cfg.max_step / max(size, 1e-6) if size > cfg.max_step else 1.0
                sx, sy = sx * cfg.smooth_prev + (sx + dx * scale) * (1 - cfg.smooth_prev), sy * cfg.smooth_prev + (sy + dy * scale) * (1 - cfg.smooth_prev)
            known[role, track] = (frame, sx, sy)
            rows.append((key[0], role, track, frame, sx, sy))
        now = state.getCurrentWatermarkMs()
        held = [(*k, *v) for k, v in known.items() if until(v[0]) > now]
        state.update(tuple(map(list, zip(*held))) if held else tuple([] for _ in fields))
        state.setTimeoutTimestamp(max([now + 1, *(until(v[2]) for v in held)]))
        yield pd.DataFrame(rows, columns=["game_id", "is_referee", "track_id", "frame_idx", "sx", "sy"])

    return (
        by_lane(with_time(points, fps).withWatermark("ts", late))
        .applyInPandasWithState(step, out, "is_referee array<boolean>, track_id array<long>, last array<long>, sx array<double>, sy array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def jersey_stream(reads: DataFrame, cfg: Config = DEFAULT, fps: int = FPS, late: str = "2 seconds") -> DataFrame:
    """Locks of tracks as votes come: a row when a track's first number has its votes. The cap on owners is applied downstream, where
    locks of all tracks meet. State is the votes and locked ids of a lane of tracks; it expires once the game is over, which the caller bounds by `GAME`
    frames without a read, for a removed id doesn't come back within a game."""
    from trackweave.operators.jersey import cleaned

    accepted = cleaned(reads).where((F.col("conf") > cfg.ocr_conf) & F.col("number").isNotNull() & (F.col("frame_idx") % cfg.ocr_every == 0))

    def vote(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, tracks, names, counts = state.get if state.exists else ([], [], [], [])
        locked, bank, found, last = set(done), dict(zip(zip(tracks, names), counts)), [], 0
        for track, frame, det, number in in_frames(frames, ["frame_idx", "det_id"], ["track_id", "frame_idx", "det_id", "number"]):
            last = frame
            if track in locked:
                continue
            n = bank[track, number] = bank.get((track, number), 0) + 1
            if n >= cfg.votes:
                locked.add(track)
                found.append((key[0], track, frame, det, number))
        bank = {k: n for k, n in bank.items() if k[0] not in locked}
        state.update((sorted(locked), [t for t, _ in bank], [name for _, name in bank], list(bank.values())))
        state.setTimeoutTimestamp(max(int((last + GAME) * 1000 / fps), state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=["game_id", "track_id", "frame_idx", "det_id", "number"])

    return (
        by_lane(with_time(accepted, fps).withWatermark("ts", late))
        .applyInPandasWithState(vote, "game_id int, track_id long, frame_idx long, det_id long, number string", "locked array<long>, tracks array<long>, names array<string>, counts array<int>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def activation_stream(counted: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First frame in which each track has enough points on the court, so far: a running minimum (update mode)."""
    return counted.where(F.col("n_inside") >= cfg.activate_points).groupBy("game_id", "is_referee", "track_id").agg(F.min("frame_idx").alias("active_from"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts of event types, with late rows up to the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: rows nearer than a gap belong together."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_in_window(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
