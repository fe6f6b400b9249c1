"""Positions on the court over time: smoothing with a step limit and gap resets, trails, sticky activation.

Smoothing depends on its own last value, so it is a native fold over a track's points. A track's points are cut at gaps first, where
the state is reset anyway, so a fold's array is one unbroken stay, not a whole game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.fold import running
from trackweave.functions.geometry import box, foot, project
from trackweave.operators.matching import FRAME

KEY = ("game_id", "is_referee", "track_id")


def feet(tracks: DataFrame, h: list[float] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Foot points of tracks, projected by a homography where one is given."""
    x, y = foot(box(), cfg.foot_lift)
    rows = tracks.select(*KEY, "frame_idx", x.alias("x"), y.alias("y"))
    if h is None:
        return rows
    px, py = project(F.col("x"), F.col("y"), h)
    return rows.select(*KEY, "frame_idx", px.alias("x"), py.alias("y"))


def stays(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Points with the number of their stay: a gap of more than `gap` frames begins a new one."""
    own = Window.partitionBy(*KEY).orderBy("frame_idx")
    fresh = F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(own) > cfg.gap).cast("int"), F.lit(0))
    return points.withColumn("_f", fresh).withColumn("stay", F.sum("_f").over(own)).drop("_f")


def pans_in_force(frames: DataFrame, states: DataFrame, sure: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(game_id, frame_idx, pan_dx, pan_conf) of each frame: the camera's pan after the last update, of `keypoints.pan_state`, as long as it is sure and the last
    sure update, of `court.pan_prior`, isn't too old. A running window over a row for each frame and update of a game."""
    told = sure.where(F.col("conf") >= cfg.pan_min_conf).select(*FRAME, F.col("frame_idx").alias("sure_frame"))
    updates = states.select(*FRAME, F.struct("pan_dx", "pan_conf").alias("s")).join(told, list(FRAME), "left").withColumn("asked", F.lit(False))
    rows = frames.select(*FRAME, F.lit(True).alias("asked")).distinct().unionByName(updates, allowMissingColumns=True)
    upto = Window.partitionBy("game_id").orderBy("frame_idx", "asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.last("s", ignorenulls=True).over(upto)).withColumn("sure_frame", F.last("sure_frame", ignorenulls=True).over(upto))
    good = (F.col("s.pan_conf") >= cfg.pan_min_conf) & (F.col("frame_idx") - F.col("sure_frame") <= cfg.pan_max_age)
    force = lambda c: F.when(good, F.col(f"s.{c}")).otherwise(0.0).alias(c)
    return rows.where("asked").select(*FRAME, force("pan_dx"), force("pan_conf"))


def step(prev: Column, p: Column, cfg: Config = DEFAULT) -> Column:
    """The next smoothed point from the last one and a new target. Where the camera pans, a target against the pan is damped, and another one drawn to
    where the pan alone would take it."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(cfg.court_w - 1.0)))
    away, pan, weight = p["x"] - prev["sx"], p["pan_dx"], p["pan_conf"] * cfg.pan_weight
    against = (F.abs(away) >= 0.5) & (away * pan < 0)
    damped = clip(prev["sx"] + away * cfg.pan_damping + pan * (1.0 - cfg.pan_damping))
    drawn = F.when(weight > 0, clip(p["x"] * (1.0 - weight) + clip(prev["sx"] + pan) * weight)).otherwise(p["x"])
    x = F.when(F.abs(pan) >= 0.1, F.when(against, damped).otherwise(drawn)).otherwise(p["x"])
    dx, dy = x - prev["sx"], p["y"] - prev["sy"]
    size = F.sqrt(dx * dx + dy * dy)
    scale = F.when(size > cfg.max_step, F.lit(cfg.max_step) / F.greatest(size, F.lit(1e-6))).otherwise(F.lit(1.0))
    mixed = lambda p, q: p * cfg.smooth_prev + q * (1.0 - cfg.smooth_prev)
    return F.struct(mixed(prev["sx"], prev["sx"] + dx * scale).alias("sx"), mixed(prev["sy"], prev["sy"] + dy * scale).alias("sy"))


def smooth(points: DataFrame, cfg: Config = DEFAULT, pans: DataFrame | None = None) -> DataFrame:
    """Smoothed points of every stay: the first is the target itself. `pans` has the pan that is in force in each frame (none, where it isn't given)."""
    none = points.withColumns({"pan_dx": F.lit(0.0), "pan_conf": F.lit(0.0)})
    rows = none if pans is None else points.join(pans, list(FRAME), "left").fillna(0.0, ["pan_dx", "pan_conf"])
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "pan_dx", "pan_conf")))
    grouped = stays(rows, cfg).groupBy(*KEY, "stay").agg(seq.alias("pts"))
    out = lambda f, x, y, sx, sy: F.struct(f.alias("frame_idx"), x.alias("x"), y.alias("y"), sx.alias("sx"), sy.alias("sy"))

    def add(last: Column, p: Column) -> Column:
        n = step(last, p, cfg)
        return out(p["frame_idx"], p["x"], p["y"], n["sx"], n["sy"])

    folded = running(F.col("pts"), lambda p: out(p["frame_idx"], p["x"], p["y"], p["x"], p["y"]), add)
    return grouped.select(*KEY, "stay", F.inline(folded))


def trails(smoothed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each point with the last points of its stay, itself included, oldest first."""
    w = Window.partitionBy(*KEY, "stay").orderBy("frame_idx").rowsBetween(1 - cfg.trail, 0)
    return smoothed.withColumn("trail", F.collect_list(F.struct("sx", "sy")).over(w))


def court_points(tracks: DataFrame, h: list[float], cfg: Config = DEFAULT) -> DataFrame:
    """How many of five points of each box lie on the court: three along its foot, two up its middle."""
    w, high = (F.greatest(F.lit(1), F.col(b) - F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2")))
    on = F.lit(0)
    for x, y in ((0.50, None), (0.25, None), (0.75, None), (0.50, 0.80), (0.50, 0.65)):
        px, py = project(F.col("x1") + w * x, F.col("y2") if y is None else F.col("y1") + high * y, h)
        on = on + ((px >= 0) & (px < cfg.court_w) & (py >= 0) & (py < cfg.court_h)).cast("int")
    return tracks.withColumn("n_inside", on)


def activated(counted: DataFrame, masked: DataFrame, stale: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sticky activation: a player is active from the first frame in which its mask or enough points of its box lie on the court; referees always are.

    `counted` has the tracks with n_inside, `masked` the court overlap of each player's clipped mask (overlap, inside_area), and `stale` the frames whose
    homography is missing or old. A track without a mask on the court is put off in these, and where one is missing its box counts for nothing
    (the caller gives n_inside 0)."""
    m = masked.select(*FRAME, "track_id", "overlap", "inside_area", F.lit(False).alias("is_referee"))
    rows = counted.join(m, [*FRAME, "is_referee", "track_id"], "left").join(stale.select(*FRAME, F.lit(True).alias("stale")), list(FRAME), "left")
    by_mask = F.coalesce((F.col("overlap") >= cfg.activate_overlap) & (F.col("inside_area") >= cfg.activate_area), F.lit(False))
    absent = F.coalesce(F.col("inside_area"), F.lit(0)) == 0
    hit = (by_mask | (F.col("n_inside") >= cfg.activate_points)) & ~(absent & F.coalesce("stale", F.lit(False)))
    w = Window.partitionBy(*KEY).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("active", F.col("is_referee") | (F.max(hit.cast("int")).over(w) == 1)).drop("overlap", "inside_area", "stale")
