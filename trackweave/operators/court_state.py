"""The court's keypoints and homography over a game: all rules of `keypoints`, `court` and `homography` together, with their resets.

Each update goes through: border, observed side, side hysteresis (a switch forgets the departing side's points and asks for a new
homography), jumps (too many forget all points), points that hang still, outliers under a first homography, smoothing and carry-over,
choice between the normal and the mirrored template, and acceptance, or the last good state where that fails. What a step does depends
on what earlier ones accepted, so a game is one machine, fed in order. Games run apart, but an update of each of several games is one set of arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from trackweave.config import DEFAULT, Config
from trackweave.operators.homography import H, apply, draws_of, estimate_all, medians, mirror
from trackweave.operators.ordered import Rows, in_order
from trackweave.sources import court_template as T

COUNT = len(T.TEMPLATE)
SCHEMA = (
    "game_id int, frame_idx long, status string, mode string, observed string, layout string, court_side string, switched boolean, reset boolean, streak int, "
    "n_valid int, n_carried int, score double, reproj double, " + ", ".join(f"{h} double" for h in H) + ", xs array<double>, ys array<double>, confs array<double>"
)
SIDES = {"left": [*T.LEFT, *T.LEFT_INNER], "right": [*T.RIGHT, *T.RIGHT_INNER]}


def nine(cfg: Config) -> np.ndarray:
    """The frame's corners, the middles of its edges, and its centre."""
    return np.array([(x, y) for y in (0.0, cfg.frame_h * 0.5, cfg.frame_h - 1.0) for x in (0.0, cfg.frame_w * 0.5, cfg.frame_w - 1.0)])


def length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(-1))


#: All pairs of keypoints of one line across the court.
PAIRS = np.array([(i, j) for line in (T.LEFT, T.CENTER, T.LEFT_INNER, T.RIGHT, T.RIGHT_INNER) for k, i in enumerate(line) for j in line[k + 1 :]])
TARGET = np.array([(tx, ty) for _, tx, ty, _ in T.TEMPLATE], float)
#: Frames whose homographies are estimated at once, and games that go on at once: their arrays stay in a core's cache.
CHUNK = 16


@dataclass
class Ready:
    """What an update is before its game's state is known: points within the border, the side of their layout, its random numbers, and (H, whether it passes, residual)
    of its sure points."""

    xy: np.ndarray
    conf: np.ndarray
    line_side: str | None
    draws: np.ndarray
    first: tuple[np.ndarray, np.ndarray, np.ndarray]


def inside(p: np.ndarray, cfg: Config) -> np.ndarray:
    m = cfg.border
    return (p[..., 0] >= m) & (p[..., 0] < cfg.frame_w - m) & (p[..., 1] >= m) & (p[..., 1] < cfg.frame_h - m)


def layouts(xy: np.ndarray, conf: np.ndarray, cfg: Config) -> list[str | None]:
    """The side that each update's layout says."""
    usable, (i, j) = (xy > 0).all(2) & (conf >= cfg.slope_conf), PAIRS.T
    d = xy[:, j] - xy[:, i]
    good = usable[:, i] & usable[:, j] & (np.abs(d[..., 1]) >= cfg.slope_dy)
    slopes = np.where(good, d[..., 0] / np.where(good, d[..., 1], 1.0), np.nan)
    known = good.sum(1) >= cfg.slope_pairs
    return [None if not k or abs(s) < cfg.slope_min else "left" if s < 0 else "right" for k, s in zip(known.tolist(), medians(slopes).tolist())]


def sure_points(xy: np.ndarray, conf: np.ndarray, cfg: Config) -> np.ndarray:
    return np.where((conf >= cfg.geometry_conf)[..., None] & (xy > 0), xy, 0.0)


def prepared(rows: Rows, cuts: list[int], cfg: Config = DEFAULT) -> list[Ready]:
    """Updates as they come in, many at once."""
    n = len(cuts) - 1
    of, at, frames = np.repeat(np.arange(n), np.diff(cuts)), rows["kp_idx"], rows["frame_idx"][cuts[:-1]]
    xy, conf = np.zeros((n, COUNT, 2)), np.zeros((n, COUNT))
    xy[of, at], conf[of, at] = np.nan_to_num(np.stack([rows["x"], rows["y"]], axis=1).astype(float)), rows["conf"]
    xy[~inside(xy, cfg)] = 0.0
    sides, out = layouts(xy, conf, cfg), []
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        sure, draws = sure_points(xy[a:b], conf[a:b], cfg), draws_of(frames[a:b], COUNT)
        found = estimate_all(sure, np.broadcast_to(TARGET, sure.shape), (sure > 0).all(2), frames[a:b], cfg, draws=draws)
        out += [Ready(xy[k], conf[k], sides[k], draws[k - a : k - a + 1], tuple(v[k - a : k - a + 1] for v in found)) for k in range(a, b)]
    return out


class Court:
    """State of one game. A missing point is (0, 0)."""

    def __init__(self, game: int, cfg: Config = DEFAULT):
        self.game, self.cfg = game, cfg
        self.good: np.ndarray | None = None
        self.before = np.zeros((COUNT, 2))
        self.still = np.zeros(COUNT, int)
        self.missing = np.full(COUNT, cfg.carry_updates + 1)
        self.h: np.ndarray | None = None
        self.mode: str | None = None
        self.side: str | None = None
        self.pending: str | None = None
        self.count = self.transition = self.streak = 0
        self.reseed = False
        self.center: float | None = None
        self.line_side: str | None = None

    def observe(self, xy: np.ndarray, conf: np.ndarray, line_side: str | None) -> str | None:
        """The side that the frame shows: by layout, centre line, its last place, or counts."""
        cfg, seen = self.cfg, (xy > 0).all(1) & (conf >= self.cfg.keypoint_conf)
        self.line_side = line_side
        if self.line_side:
            return self.line_side
        middle = [xy[k, 0] for k in T.CENTER if seen[k]]
        if middle:
            self.center = float(np.mean(middle))
            share = self.center / cfg.frame_w
            return "right" if share < cfg.center_band else "left" if share > 1.0 - cfg.center_band else "center"
        if self.center is not None:
            return "right" if self.center / cfg.frame_w < 0.5 else "left"
        left, right = (int(seen[SIDES[s]].sum()) for s in ("left", "right"))
        if right >= cfg.side_min and right >= left + cfg.side_margin:
            return "right"
        return "left" if left >= cfg.side_min and left >= right + cfg.side_margin else None

    def turn(self, observed: str | None) -> bool:
        """Count towards a switch of sides, and make it when it is due."""
        if observed not in ("left", "right") or observed == self.side:
            self.pending, self.count = None, 0
        elif observed == self.pending:
            self.count += 1
        else:
            self.pending, self.count = observed, 1
        if self.side is None or self.pending is None or self.count < self.cfg.hysteresis:
            return False
        gone = SIDES[self.side]
        self.side, self.pending, self.count = self.pending, None, 0
        if self.good is not None:
            self.good[gone] = 0.0
        self.forget(gone)
        self.transition, self.reseed = self.cfg.transition_updates, True
        return True

    def forget(self, which) -> None:
        self.before[which], self.still[which], self.missing[which] = 0.0, 0, self.cfg.carry_updates + 1

    def choose(self, observed: str | None, mean: float, residual: float, shifts: list[tuple[float, float]] | None) -> tuple[int, float]:
        """(0 for the normal template or 1 for the mirrored one, score) of the better of both. `mean` is that of the used points' x on the court, `shifts` are the
        means and maxima by which either moves the last homography's frame, where that counts."""
        cfg, best = self.cfg, None
        for k, (mode, x) in enumerate((("normal", mean), ("mirrored", cfg.court_w - mean))):
            score = residual
            if shifts is not None:
                score += cfg.stability * shifts[k][0] + cfg.shift_weight * shifts[k][1]
                if self.mode not in (None, mode) and not self.reseed:
                    score += cfg.mode_penalty
            side = "left" if x < cfg.side_low * cfg.court_w else "right" if x > cfg.side_high * cfg.court_w else "center"
            if "left" in (observed, side) and "right" in (observed, side):
                score += cfg.side_penalty
            if best is None or score < best[1]:
                best = (k, score)
        return best

    def accepts(self, n: int, reproj: float, shift: tuple[float, float] | None) -> bool:
        """Whether a homography that passes the gates, of n points, becomes the state."""
        cfg = self.cfg
        if shift is None:
            return n >= max(cfg.update_min, cfg.cold_min)
        if n < cfg.update_min:
            return False
        many = n >= max(cfg.update_min, cfg.transition_min)
        if self.reseed:
            return many and reproj <= cfg.recover_reproj
        if many and reproj <= cfg.good_reproj or self.streak >= cfg.recover_streak and reproj <= cfg.recover_reproj:
            return True
        strict = self.transition > 0
        if strict and n < cfg.transition_min:
            return False
        part = cfg.strictness if strict else 1.0
        return bool(np.isfinite(shift).all() and shift[0] <= cfg.mean_shift * part and shift[1] <= cfg.point_shift * part)

    def step(self, frame: int, ready: Ready) -> list[tuple]:
        return steps([self], [frame], [ready])


def estimated(xy: np.ndarray, frames: np.ndarray, draws: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return estimate_all(xy, np.broadcast_to(TARGET, xy.shape), (xy > 0).all(2), frames, cfg, draws=draws)


def both_ways(found: np.ndarray, cfg: Config) -> np.ndarray:
    """Homographies to the normal template, and those to the mirrored one."""
    return np.stack([found, mirror(cfg) @ found], axis=1)


def mean_x(xy: np.ndarray) -> list[float]:
    """Where the used points of each update lie on the court, on average."""
    use = (xy > 0).all(2)
    return ((use * TARGET[:, 0]).sum(1) / np.maximum(1, use.sum(1))).tolist()


def moves(found: np.ndarray, last: np.ndarray, cfg: Config) -> list[list[tuple[float, float]]]:
    """(mean, maximum) of how far the frame moves on the court between the last homography and each of those found."""
    points = nine(cfg)
    shift = length(apply(found, points) - apply(last, points)[:, None])
    return [list(zip(*p)) for p in zip(shift.mean(2).tolist(), shift.max(2).tolist())]


def steps(courts: list[Court], frames: list[int], ready: list[Ready]) -> list[tuple]:
    """An update of each of several games."""
    cfg, every, frame_of = courts[0].cfg, range(len(courts)), np.array(frames)
    xy, conf, draws = np.stack([r.xy for r in ready]), np.stack([r.conf for r in ready]), np.concatenate([r.draws for r in ready])
    observed = [c.observe(p, k, r.line_side) for c, p, k, r in zip(courts, xy, conf, ready)]
    switched = [c.turn(o) for c, o in zip(courts, observed)]

    # Too many jumps forget all points.
    here, had = inside(xy, cfg), np.array([c.good is not None for c in courts])
    good = np.stack([np.zeros((COUNT, 2)) if c.good is None else c.good for c in courts])
    known = inside(good, cfg) & had[:, None]
    both = here & known
    far = both & (length(xy - good) > cfg.jump_reset_px)
    reset = both.any(1) & (far.sum(1) > cfg.jump_reset_share * both.sum(1))
    for g in np.flatnonzero(reset).tolist():
        courts[g].good = None
        courts[g].forget(slice(None))
    known &= ~reset[:, None]

    # Points that hang still are dropped.
    before, bx, by = np.stack([c.before for c in courts]), cfg.frame_w * cfg.edge_band, cfg.frame_h * cfg.edge_band
    x, y = xy[..., 0], xy[..., 1]
    band = (x <= bx) | (x >= cfg.frame_w - bx) | (y <= by) | (y >= cfg.frame_h - by)
    hangs = here & band & inside(before, cfg) & (length(xy - before) <= cfg.still_px)
    still = np.where(hangs, np.stack([c.still for c in courts]) + 1, 0)
    before = np.where(here[..., None], xy, 0.0)
    gone = still >= cfg.still_updates
    xy[gone], conf[gone] = 0.0, 0.0

    # Outliers under a first homography.
    sure = sure_points(xy, conf, cfg)
    found, ok, residual = (np.concatenate([r.first[k] for r in ready]) for k in range(3))
    again = np.flatnonzero(gone.any(1))
    if len(again):
        found[again], ok[again], residual[again] = estimated(sure[again], frame_of[again], draws[again], cfg)
    some = np.flatnonzero(ok)
    if len(some):
        means, left = mean_x(sure), residual.tolist()
        mode = np.array([courts[g].choose(observed[g], means[g], left[g], None)[0] for g in some.tolist()])
        image = np.stack([TARGET, np.c_[cfg.court_w - TARGET[:, 0], TARGET[:, 1]]])[mode]
        seen = xy[some]
        seen[(seen[..., 0] > 0) & (length(apply(both_ways(found[some], cfg)[np.arange(len(some)), mode], seen) - image) > cfg.outlier_px)] = 0.0
        xy[some] = seen

    # Smoothing and carry-over.
    here = inside(xy, cfg)
    missing = np.where(here, 0, np.stack([c.missing for c in courts]) + 1)
    both, held = here & known, ~here & known & (missing <= cfg.carry_updates)
    xy = np.where(both[..., None], cfg.ema_new * xy + (1 - cfg.ema_new) * good, np.where(held[..., None], good, xy))
    carried = held.sum(1).tolist()
    out = ~inside(xy, cfg)
    xy[out], conf[out] = 0.0, 0.0

    # Choice and acceptance.
    n = (xy > 0).all(2).sum(1).tolist()
    found, ok, residual = estimated(xy, frame_of, draws, cfg)
    ways, means, left = both_ways(found, cfg), mean_x(xy), residual.tolist()
    then = [g for g in every if ok[g] and courts[g].h is not None]
    shifts = dict(zip(then, moves(ways[then], np.stack([courts[g].h for g in then]), cfg))) if then else {}
    told = []
    for g, c in enumerate(courts):
        c.before, c.still, c.missing, status, p = before[g], still[g], missing[g], None, xy[g]
        best = c.choose(observed[g], means[g], left[g], shifts.get(g)) if ok[g] else None
        if best and c.accepts(n[g], left[g], shifts[g][best[0]] if g in shifts else None):
            c.h, c.mode, c.good, c.reseed, status = ways[g, best[0]], ("normal", "mirrored")[best[0]], p.copy(), False, "ok"
            if observed[g] in ("left", "right"):
                c.side = observed[g]
        else:
            status = "fallback" if c.h is not None else "fail"
            if c.h is not None and c.good is not None:
                p = c.good
        c.transition = max(0, c.transition - 1)
        c.streak = 0 if status == "ok" else c.streak + 1
        h = [None] * 9 if c.h is None else c.h.ravel().tolist()
        what = (status, c.mode, observed[g], c.line_side, c.side, switched[g], bool(reset[g]), c.streak, n[g], carried[g], best and best[1], best and left[g])
        told.append((c.game, frames[g], *what, *h, p[:, 0].tolist(), p[:, 1].tolist(), conf[g].tolist()))
    return told


def court_run(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each update: what became of its homography, the side, the resets, and the keypoints that hold after it ((0, 0): none)."""
    rows = keypoints.select("game_id", "frame_idx", "kp_idx", "x", "y", "conf")
    return in_order(rows, ["game_id"], "frame_idx", ["kp_idx"], lambda key: Court(key[0], cfg), SCHEMA, lambda rows, cuts: prepared(rows, cuts, cfg), steps, CHUNK)
