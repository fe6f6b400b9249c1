"""A run of a whole game: detections, pictures of masks and updates of the court come in as one ordered feed, and each frame goes through all rules that
hang on each other's results, association, mask ownership, suppression and activation.

What needs no earlier decision stays outside, as joins and windows over what the machine tells: lifecycles, aliases, jersey numbers,
projection and smoothing."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.operators.association import Tracker, whole_overlap
from trackweave.operators.homography import H, apply
from trackweave.operators.mask_state import Drawn, Ownership, Player, Seen, packed, prepared
from trackweave.operators.matching import BOX, FRAME, targets
from trackweave.operators.ordered import Rows, in_order, merged

OUT = (
    "game_id int, frame_idx long, kind string, is_referee boolean, track_id long, det_id long, x1 long, y1 long, x2 long, y2 long, confidence double, "
    "shown boolean, active boolean, place int, mask_id long, by_mask boolean, fx double, fy double, other_id long"
)
#: A mask's overlap with the court is taken from so many of its pixels at most, in equal steps.
SAMPLE = 2500
NO_DETECTIONS = {"is_referee": np.zeros(0, bool), "det_id": np.zeros(0, np.int64), "confidence": np.zeros(0), **{c: np.zeros(0) for c in BOX}}


def on_court(points: np.ndarray, h: np.ndarray, cfg: Config) -> np.ndarray:
    """Which image points lie on the court's picture."""
    p = apply(h, points)
    return (p[:, 0] >= 0) & (p[:, 0] < cfg.court_w) & (p[:, 1] >= 0) & (p[:, 1] < cfg.court_h)


def pixels(runs: np.ndarray, every: int = 1) -> np.ndarray:
    """(x, y) of all pixels of runs, row by row, or of each so many-th of them."""
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    upto = np.cumsum(runs[:, 2] - runs[:, 1])
    k = np.arange(0, upto[-1] if len(upto) else 0, every)
    of = np.searchsorted(upto, k, side="right")
    return np.stack([runs[of, 2] + k - upto[of], runs[of, 0]], axis=1)


def mask_overlap(runs: np.ndarray, h: np.ndarray, cfg: Config) -> tuple[float, int]:
    """Share of a mask's sampled pixels on the court, and the pixels that this stands for."""
    n = int((runs[:, 2] - runs[:, 1]).sum())
    share = float(on_court(pixels(runs, max(1, n // SAMPLE)).astype(float), h, cfg).mean()) if n else 0.0
    return share, round(n * share)


def of_sorted(v: np.ndarray, upto: np.ndarray, skip: int, share: float) -> float:
    """`np.percentile` of sorted values, each repeated and so counted up to a number, without the first `skip`."""
    n = int(upto[-1]) - skip
    at = (n - 1) * share
    k = int(at)
    low, high = (float(v[np.searchsorted(upto, skip + j, side="right")]) for j in (k, min(k + 1, n - 1)))
    t = at - k
    return high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t


def middle_x(start: np.ndarray, end: np.ndarray) -> float:
    """The median x of the pixels of runs, counted by x and never spread out."""
    first = int(start.min())
    wide = int(end.max()) - first + 1
    upto = np.cumsum(np.cumsum(np.bincount(start - first, minlength=wide) - np.bincount(end - first, minlength=wide)))
    n = int(upto[-1])
    return first + float(np.searchsorted(upto, (n - 1) // 2, side="right") + np.searchsorted(upto, n // 2, side="right")) / 2


def mask_foot(runs: np.ndarray) -> tuple[float, float]:
    """Of the pixels at or below the 88th percentile of y, or of the last rows where these are few, the median x and the 96th percentile of y."""
    y, start, end = runs[np.argsort(runs[:, 0], kind="stable")].T
    upto = np.cumsum(end - start)
    before = lambda r: int(upto[r - 1]) if r else 0
    low = int(np.searchsorted(y, of_sorted(y, upto, 0, 0.88)))
    if upto[-1] - before(low) < 4:
        low = int(np.searchsorted(y, max(y[-1] - 3.0, 0.0)))
    return middle_x(start[low:], end[low:]), of_sorted(y, upto, before(low), 0.96)


class Game:
    """State of one game."""

    def __init__(self, game: int, cfg: Config = DEFAULT):
        self.game, self.cfg = game, cfg
        self.tracker, self.masks, self.seen = Tracker(game, cfg, whole=True), Ownership(cfg), Seen(cfg.buffer)
        self.h: np.ndarray | None = None
        self.streak = 0
        self.active: set[int] = set()
        self.birth: dict[tuple[bool, int], tuple[int, float, float]] = {}

    def kept(self, frame: int, rows: list[tuple]) -> list[tuple]:
        """Rows (role, id, box, confidence) left by suppression, in its order, by age and confidence: those born apart in time or place both stay, unless a
        young one lies on an established one."""
        cfg = self.cfg
        for role, track, box, _ in rows:
            self.birth.setdefault((role, track), (frame, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2))
        if not rows:
            return []
        born = [self.birth[r[0], r[1]] for r in rows]
        age = [frame - b[0] for b in born]

        def bars(j: int, k: int) -> bool:
            v = whole_overlap(rows[j][2], rows[k][2])
            if rows[j][0] != rows[k][0]:
                return v >= cfg.cross_role_iou
            if v < cfg.track_same_iou:
                return False
            young, old = sorted((age[j], age[k]))
            if young <= cfg.young_age and old >= cfg.old_age and v >= cfg.track_young_iou:
                return True
            (f, x, y), (g, u, w) = born[j], born[k]
            return abs(f - g) <= cfg.birth_gap and sqrt((x - u) ** 2 + (y - w) ** 2) <= cfg.birth_dist

        stay: list[int] = []
        for k in sorted(range(len(rows)), key=lambda k: (-min(age[k], cfg.max_age_key), -rows[k][3])):
            if not any(bars(j, k) for j in stay):
                stay.append(k)
        return [rows[k] for k in stay]

    def spots_on(self, box: tuple) -> bool:
        """Whether enough of five points of a box lie on the court."""
        x1, y1, x2, y2 = box
        w, high = max(1, x2 - x1), max(1, y2 - y1)
        spots = np.array([(x1 + w * a, y2) for a in (0.5, 0.25, 0.75)] + [(x1 + w * 0.5, y1 + high * b) for b in (0.80, 0.65)])
        return on_court(spots, self.h, self.cfg).sum() >= self.cfg.activate_points

    def activate(self, players: list[Player], found: dict[int, np.ndarray]) -> None:
        """Players become active, for good, by their mask on the court or by two of five points of their box."""
        cfg, doubtful = self.cfg, self.h is None or self.streak >= self.cfg.stale_streak
        for p in players:
            if p.id in self.active or self.h is None:
                continue
            if not doubtful and self.spots_on(p.box):
                self.active.add(p.id)
                continue
            share, area = mask_overlap(found[p.id], self.h, cfg) if p.id in found else (0.0, 0)
            if area == 0 and doubtful:
                continue
            if share >= cfg.activate_overlap and area >= cfg.activate_area or doubtful and self.spots_on(p.box):
                self.active.add(p.id)

    def step(self, frame: int, tables: dict[str, Rows | Drawn]) -> list[tuple]:
        cfg, m = self.cfg, self.masks
        if "court" in tables:
            c = tables["court"]
            self.streak, known = int(c["streak"][-1]), c["h0"][-1]
            self.h = None if known is None or np.isnan(known) else np.array([c[k][-1] for k in H], float).reshape(3, 3)
        rows = [(r[2], r[3], tuple(r[5:9]), r[9], r[4]) for r in self.tracker.step(frame, tables.get("det", NO_DETECTIONS))]
        players = [r for r in rows if not r[0]]
        new, left = self.seen.step(frame, [r[1] for r in players])
        m.told = []
        m.redraw(frame, tables.get("mask"))
        holding = [(t, m.owner[t]) for t in left if t in m.owner]
        online = m.without_duplicates([Player(t, box, self.tracker.born[False, t], conf) for _, t, box, conf, _ in players])
        m.schedule(frame, online)
        free = m.without_conflicts(online, [Player(t, box, 0, conf) for ref, t, box, conf, _ in rows if ref])
        kept = {p.id: p for p in free}
        stay = {r[:2]: n for n, r in enumerate(self.kept(frame, [r[:4] for r in rows if r[0] or r[1] in kept]))}
        shown = [p for p in free if (False, p.id) in stay]
        found = m.look(shown)
        self.activate(shown, found)
        active = [p for p in shown if p.id in self.active]
        for _ in range(cfg.looks - 1):
            found = m.look(active)
        m.close(frame, online, new, left)
        here, out = {p.id for p in online}, []
        for ref, t, box, conf, det in rows:
            if ref or t in here:
                on, runs = (ref, t) in stay, None if ref else found.get(t)
                foot = (None, None) if ref else ((box[0] + box[2]) / 2.0, float(max(box[1], box[3] - cfg.foot_lift))) if runs is None else mask_foot(runs)
                out.append((self.game, frame, "track", ref, t, det, *box, conf, on, on and (ref or t in self.active), stay.get((ref, t)), None if ref else m.owner.get(t), runs is not None, *foot, None))
        none = (None,) * 6
        event = lambda kind, t, mask, other: (self.game, frame, kind, False, t, *none, None, None, None, mask, None, None, None, other)
        return out + [event("reuse", t, mask, other) for t, kind, mask, other, _ in m.told if kind == "reuse"] + [event("holding", t, mask, None) for t, mask in holding]


def game_run(detections: DataFrame, runs: DataFrame, state: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of kind `track`: every track of each frame that associations and masks leave, whether suppression leaves it (`shown`, and `place`, its
    order there), whether it is active too, its mask, and its foot, by its mask or else its box; kind `reuse`: a track takes over the mask of `other_id`; kind `holding`: a track is removed while it
    has a mask.

    `state` has the court's updates, as `court_state.court_run` gives; each holds until the next."""
    tables = {
        "court": state.select(*FRAME, "streak", *H),
        "det": targets(detections, cfg).select(*FRAME, F.col("det_id").alias("place"), "is_referee", "det_id", *BOX, "confidence"),
        "mask": packed(runs).withColumn("place", F.col("mask_id")),
    }
    columns = {name: rows.columns for name, rows in tables.items()}
    return in_order(merged(tables), ["game_id"], "frame_idx", ["_table", "place"], lambda key: Game(key[0], cfg).step, OUT, lambda rows, cuts: prepared(rows, cuts, columns))
