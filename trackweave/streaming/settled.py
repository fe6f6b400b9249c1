"""Streams whose rows are taken in order of frames, however late they come: lifecycles, and jersey numbers with their cap on owners.

Rows wait in state until the watermark has passed them, so what comes late but within the bound is in its place, and what a frame doesn't
bring (a track that is lost, or removed after its buffer) is told by event-time timers. The results are those of the batch operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trackweave.config import DEFAULT, Config
from trackweave.functions.geometry import box, center
from trackweave.operators.jersey import cleaned
from trackweave.streaming.stateful import FPS, by_lane, with_time

EVENTS = "game_id int, is_referee boolean, track_id long, frame_idx long, kind string, n long"
LOCKS = "game_id int, number string, track_id long, frame_idx long, det_id long, ts timestamp"
LINKS = "game_id int, is_referee boolean, frame_idx long, source_kind string, source_id long, new_id long, dist double, dt long"
OWNED = "game_id int, track_id long, frame_idx long, det_id long, number string, owner long, jersey string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Settled(StatefulProcessor):
    """Gathers rows of a key until the watermark has passed them; then `settle(key, rows in order, watermark)` gives output rows, and `due()` the time
    (milliseconds) at which the key is to be looked at even without rows."""

    columns, output, order = "frame_idx long", "", ("frame_idx",)
    #: Milliseconds beyond a row's time that the watermark has to reach.
    margin = 1

    def init(self, handle) -> None:
        self.handle = handle
        self.fields = [c.split()[0] for c in self.columns.split(", ")]
        self.waiting = handle.getListState("waiting", f"{self.columns}, ms long")
        self.timer = handle.getValueState("timer", "ms long")

    def settle(self, key: tuple, rows: list[dict], watermark: int) -> Iterable[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        return None

    def plan(self, at: int | None) -> None:
        """Be called when the watermark passes a time, and at no other."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ms = None
        for frame in rows:
            self.waiting.appendList(list(zip(*(frame[c].tolist() for c in (*self.fields, "ms")))))
            ms = int(frame["ms"].min()) if ms is None else min(ms, int(frame["ms"].min()))
        if ms is not None:
            before = self.timer.get()[0] if self.timer.exists() else None
            at = ms + self.margin
            self.plan(at if before is None else min(before, at))
        yield pd.DataFrame([], columns=[c.split()[0] for c in self.output.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip([*self.fields, "ms"], r)) for r in self.waiting.get()] if self.waiting.exists() else []
        settled = lambda r: r["ms"] + self.margin <= watermark
        ready, rest = [r for r in rows if settled(r)], [r for r in rows if not settled(r)]
        if ready:
            if rest:
                self.waiting.put([tuple(r.values()) for r in rest])
            else:
                self.waiting.clear()
        out = list(self.settle(key, sorted(ready, key=lambda r: tuple(r[c] for c in self.order)), watermark))
        self.timer.clear()
        times = [r["ms"] + self.margin for r in rest]
        if (own := self.due()) is not None:
            times.append(own)
        self.plan(max(min(times), watermark + 1) if times else None)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.split(", ")])

    def close(self) -> None:
        pass


class Lifecycle(Settled):
    """A lane of tracks: new, lost, recovered, and removed once they have been unseen for longer than the buffer."""

    columns, output, order = "is_referee boolean, track_id long, frame_idx long", EVENTS, ("frame_idx",)

    def __init__(self, cfg: Config = DEFAULT, fps: int = FPS):
        self.buffer, self.fps = cfg.buffer, fps

    def init(self, handle) -> None:
        super().init(handle)
        self.tracks = handle.getListState("tracks", "is_referee boolean, track_id long, birth long, last long, lost boolean, out boolean, told boolean")
        self.next = None

    def ms(self, frame: int) -> int:
        return (frame + 1) * 1000 // self.fps

    def settle(self, key, rows, watermark):
        known = {(role, track): tuple(v) for role, track, *v in (self.tracks.get() if self.tracks.exists() else ())}

        def passed(birth, last, lost, out, told, upto: int | None, events: list) -> tuple:
            """What became of a track before a frame, or before the watermark."""
            reached = lambda frame: frame < upto if upto is not None else self.ms(frame) < watermark
            if not lost and reached(last + 1):
                lost = True
                events.append((last + 1, "lost", 0))
            gone = last + self.buffer + 1
            if not out and reached(gone):
                out = True
                if not told:
                    told = True
                    events.append((gone, "removed", gone - birth))
            return birth, last, lost, out, told

        for r in rows:
            name, frame, events = (r["is_referee"], r["track_id"]), r["frame_idx"], []
            birth, last, lost, out, told = known.get(name, (None, None, False, False, False))
            if last is not None and frame <= last:
                continue
            if last is not None:
                birth, last, lost, out, told = passed(birth, last, lost, out, told, frame, events)
            if last is None or out:
                events.append((frame, "new", 0))
            elif frame - last > 1:
                events.append((frame, "recovered", frame - last - 1))
            known[name] = birth if birth is not None else frame, frame, False, False, told
            yield from ((key[0], *name, *e) for e in events)
        for name, v in known.items():
            events = []
            known[name] = passed(*v, None, events)
            yield from ((key[0], *name, *e) for e in events)
        self.tracks.put([(*name, *v) for name, v in known.items()])
        self.next = min((self.ms(last + (1 if not lost else self.buffer + 1)) + 1 for _, last, lost, out, _ in known.values() if not out), default=None)

    def due(self):
        return self.next


class Links(Settled):
    """One role of a game: new tracks that continue a lost or removed one. State has the tracks that may come back, and the places of removed ones for as long
    as they count."""

    columns, output, order = "frame_idx long, track_id long, x double, y double", LINKS, ("frame_idx", "track_id")

    def __init__(self, cfg: Config = DEFAULT):
        self.cfg = cfg

    def init(self, handle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "track_id long", "born long, last long, x double, y double")
        self.removed = handle.getMapState("removed", "track_id long, since long", "x double, y double")

    def settle(self, key, rows, watermark):
        cfg = self.cfg
        known, removed = ({k: v for k, v in m.iterator()} if m.exists() else {} for m in (self.known, self.removed))
        before = set(known), set(removed)
        for frame in dict.fromkeys(r["frame_idx"] for r in rows):
            now = {r["track_id"]: (r["x"], r["y"]) for r in rows if r["frame_idx"] == frame}
            for t in [t for t, (_, last, *_) in known.items() if frame - last > cfg.buffer]:
                born, last, x, y = known[t]
                since = last + cfg.buffer + 1
                if t[0] in now and frame == since:
                    continue  # seen again in the very frame of its removal
                if since - born >= cfg.source_life:
                    removed[t[0], since] = (x, y)
                del known[t]
            for place in [p for p in removed if frame - p[1] > cfg.switch_dt]:
                del removed[place]
            for t, (x, y) in now.items():
                if (t,) in known:
                    continue
                lost = [("lost", u, last + 1, px, py) for (u,), (_, last, px, py) in known.items() if last < frame and u not in now]
                gone = [("rm", u, since, px, py) for (u, since), (px, py) in removed.items() if since < frame]
                near = [(((x - px) ** 2 + (y - py) ** 2) ** 0.5, frame - since, kind, u) for kind, u, since, px, py in lost + gone if u != t and frame - since <= cfg.switch_dt]
                near = sorted(n for n in near if n[0] <= cfg.switch_dist)
                if near and (len(near) == 1 or near[1][0] - near[0][0] >= cfg.switch_margin):
                    dist, dt, kind, u = near[0]
                    yield *key, frame, kind, u, t, dist, dt
            for t, (x, y) in now.items():
                known[t,] = (known[t,][0] if (t,) in known else frame, frame, x, y)
        for state, values, old in ((self.known, known, before[0]), (self.removed, removed, before[1])):
            for k in old - set(values):
                state.removeKey(k)
            for k, v in values.items():
                state.updateValue(k, v)


class Votes(Settled):
    """Votes of a lane of tracks: a row when a track's first number has enough; the votes go with the lock."""

    columns, output, order = "track_id long, frame_idx long, det_id long, number string", LOCKS, ("frame_idx", "det_id")

    def __init__(self, cfg: Config = DEFAULT):
        self.votes = cfg.votes

    def init(self, handle) -> None:
        super().init(handle)
        self.bank = handle.getListState("bank", "track_id long, number string, n int")
        self.locked = handle.getListState("locked", "track_id long")

    def settle(self, key, rows, watermark):
        if not rows:
            return
        bank = {(t, number): n for t, number, n in (self.bank.get() if self.bank.exists() else ())}
        locked, fresh = {t for (t,) in (self.locked.get() if self.locked.exists() else ())}, []
        for r in rows:
            track, number = r["track_id"], r["number"]
            if track in locked:
                continue
            n = bank[track, number] = bank.get((track, number), 0) + 1
            if n >= self.votes:
                locked.add(track)
                fresh.append((track,))
                yield key[0], number, track, r["frame_idx"], r["det_id"], pd.Timestamp(max(watermark, r["ms"]), unit="ms", tz="UTC")
        rest = [(*k, n) for k, n in bank.items() if k[0] not in locked]
        if rest:
            self.bank.put(rest)
        else:
            self.bank.clear()
        if fresh:
            self.locked.appendList(fresh)


class Owners(Settled):
    """A game's numbers: the first owners of one have it, later ones stay locked without it. Locks come settled, at the watermark's own time."""

    columns, output, order = "number string, track_id long, frame_idx long, det_id long", OWNED, ("frame_idx", "det_id")
    margin = -1

    def __init__(self, cfg: Config = DEFAULT):
        self.most = cfg.owners

    def init(self, handle) -> None:
        super().init(handle)
        self.counts = handle.getListState("owners", "number string, n long")

    def settle(self, key, rows, watermark):
        if not rows:
            return
        counts = dict(tuple(r) for r in self.counts.get()) if self.counts.exists() else {}
        for r in rows:
            number = r["number"]
            n = counts[number] = counts.get(number, 0) + 1
            yield key[0], r["track_id"], r["frame_idx"], r["det_id"], number, n, number if n <= self.most else None
        self.counts.put(list(counts.items()))


def timed(rows: DataFrame, fps: int, late: str) -> DataFrame:
    """Rows with their time, as the watermark takes it and in milliseconds, whatever the session's time zone."""
    return with_time(rows, fps).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))


def lifecycle_stream(tracks: DataFrame, cfg: Config = DEFAULT, fps: int = FPS, late: str = "2 seconds") -> DataFrame:
    """Events of tracks, as `lifecycle.edges` has them, up to the watermark."""
    tracks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = timed(tracks.select("game_id", "is_referee", "track_id", "frame_idx"), fps, late)
    return by_lane(rows).transformWithStateInPandas(Lifecycle(cfg, fps), EVENTS, "append", "eventTime")


def links_stream(tracks: DataFrame, cfg: Config = DEFAULT, fps: int = FPS, late: str = "2 seconds") -> DataFrame:
    """Switches of identity by place, as `lifecycle.switch_links` has them, up to the watermark. A role's tracks of one game go through one state."""
    tracks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    x, y = center(box())
    rows = timed(tracks.select("game_id", "is_referee", "track_id", "frame_idx", x.cast("double").alias("x"), y.cast("double").alias("y")), fps, late)
    return rows.groupBy("game_id", "is_referee").transformWithStateInPandas(Links(cfg), LINKS, "append", "eventTime")


def owners_stream(reads: DataFrame, cfg: Config = DEFAULT, fps: int = FPS, late: str = "2 seconds") -> DataFrame:
    """Locked numbers of tracks with the cap on owners, as `jersey.locks` has them: two stateful steps in a row, by lanes of tracks and then by game."""
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    accepted = cleaned(reads).where((F.col("conf") > cfg.ocr_conf) & F.col("number").isNotNull() & (F.col("frame_idx") % cfg.ocr_every == 0))
    rows = timed(accepted.select("game_id", "track_id", "frame_idx", "det_id", "number"), fps, late)
    locks = by_lane(rows).transformWithStateInPandas(Votes(cfg), LOCKS, "append", "eventTime", eventTimeColumnName="ts")
    return locks.withColumn("ms", F.unix_millis("ts")).groupBy("game_id").transformWithStateInPandas(Owners(cfg), OWNED, "append", "eventTime")


def report_sink(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream's rows as JSON lines, each once: a batch's folder is named after it and written over if the batch is run again."""
    put = lambda rows, batch: rows.write.mode("overwrite").json(f"{path}/batch={batch}")
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put)

