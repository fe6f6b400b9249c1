"""Court keypoints: choice of instance, validity, and their state over time (jumps, still points, smoothing, carry-over, sides).

Temporal state is kept by (game_id, kp_idx): windows where a row depends on its neighbours only, a native fold where it depends on
its own last result. Each operator here is one rule by itself; `court_state` runs them all together with their resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.fold import running
from trackweave.functions.geometry import distance
from trackweave.operators.matching import FRAME

POINT = ("game_id", "kp_idx")


def per_point() -> WindowSpec:
    """A point's updates in order."""
    return Window.partitionBy(*POINT).orderBy("frame_idx")


def inner(cfg: Config = DEFAULT) -> Column:
    """Whether a point lies within the frame's border."""
    x, y, m = F.col("x"), F.col("y"), cfg.border
    return F.coalesce((x >= m) & (x < cfg.frame_w - m) & (y >= m) & (y < cfg.frame_h - m), F.lit(False))


def in_edge_band(cfg: Config = DEFAULT) -> Column:
    """Whether a point lies in the band along any edge of the frame."""
    x, y, bx, by = F.col("x"), F.col("y"), cfg.frame_w * cfg.edge_band, cfg.frame_h * cfg.edge_band
    return F.coalesce((x > 0) & (y > 0) & ((x <= bx) | (x >= cfg.frame_w - bx) | (y <= by) | (y >= cfg.frame_h - by)), F.lit(False))


def best_instance(instances: DataFrame, cfg: Config = DEFAULT, by_confidence: bool = False) -> DataFrame:
    """The instance of each frame with most valid points that are sure enough, confidences deciding; the first of equals. `by_confidence`: with
    most points that are sure enough, wherever they lie, as results in columns are judged."""
    sure = F.col("conf") >= cfg.geometry_conf
    good = F.coalesce((F.col("x") > 0) & (F.col("y") > 0) & sure, F.lit(False))
    score = F.count_if(sure) if by_confidence else F.count_if(good) + 0.01 * F.sum("conf")
    per = instances.groupBy(*FRAME, "instance").agg(F.count("*").alias("n"), score.alias("score"))
    first = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.col("score").desc(), "instance"))
    return per.withColumn("_n", first).where("_n = 1").drop("_n")


def validity(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per frame: valid points, points above each confidence, points inside the border and in the edge band."""
    there = F.coalesce((F.col("x") > 0) & (F.col("y") > 0), F.lit(False))
    return keypoints.groupBy(*FRAME).agg(F.count_if(there).alias("n_valid"), F.count_if(F.col("conf") >= 0.1).alias("n_low"), F.count_if(F.col("conf") >= 0.5).alias("n_high"), F.count_if(inner(cfg)).alias("n_inside"), F.count_if(in_edge_band(cfg)).alias("n_band"))


def inside_border(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Keypoints whose position is NULL where it lies at the frame's border."""
    return keypoints.withColumn("_ok", inner(cfg)).withColumn("x", F.when(F.col("_ok"), F.col("x"))).withColumn("y", F.when(F.col("_ok"), F.col("y"))).drop("_ok")


def still_runs(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """For each point how many updates in a row it has hung still in the edge band, and whether that is so long that it is dropped. A missing
    point, one outside the band or one that moves counts from 0 again."""
    own = per_point()
    near = distance((F.col("x"), F.col("y")), (F.lag("x").over(own), F.lag("y").over(own))) <= cfg.still_px
    rows = keypoints.withColumn("_hangs", F.coalesce(in_edge_band(cfg) & near, F.lit(False)).cast("int")).withColumn("_run", F.sum(1 - F.col("_hangs")).over(own))
    still = F.sum("_hangs").over(Window.partitionBy(*POINT, "_run").orderBy("frame_idx"))
    return rows.withColumn("still", still).withColumn("dropped", F.col("still") >= cfg.still_updates).drop("_hangs", "_run")


def stays(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Updates of each point, numbered, with the number of the stretch in which its state lives: a point that was missing for more updates
    than it is carried for begins a new one."""
    own = per_point()
    rows = keypoints.withColumn("_n", F.row_number().over(own))
    was = F.last(F.when(F.col("x").isNotNull(), F.col("_n")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("x").isNotNull() & (F.col("_n") - was > cfg.carry_updates + 1)
    return rows.withColumn("_f", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn("stay", F.sum("_f").over(own)).drop("_f", "_n")


def smoothed(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Moving average of each point with its last good position; a missing one is carried for a number of updates, then lost.

    A fold's array is one stretch of a point's updates, beyond which nothing is remembered."""
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    grouped = stays(keypoints, cfg).groupBy(*POINT, "stay").agg(seq.alias("pts"))
    item = lambda f, x, y, m: F.struct(f.alias("frame_idx"), x.alias("x"), y.alias("y"), m.alias("missing"))

    def add(last: Column, p: Column) -> Column:
        missed = last["missing"] + 1
        mixed = lambda c: F.when(last[c].isNull(), p[c]).otherwise(p[c] * cfg.ema_new + last[c] * (1 - cfg.ema_new))
        held = lambda c: F.when(missed <= cfg.carry_updates, last[c])
        gone = p["x"].isNull()
        either = lambda c: F.when(gone, held(c)).otherwise(mixed(c))
        return item(p["frame_idx"], either("x"), either("y"), F.when(gone, missed).otherwise(0))

    folded = running(F.col("pts"), lambda p: item(p["frame_idx"], p["x"], p["y"], F.when(p["x"].isNull(), 1).otherwise(0)), add)
    return grouped.select(*POINT, F.inline(folded))


def jump_resets(keypoints: DataFrame, last_good: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Frames in which more than a share of the keypoints lie far from their last good positions: those of `last_good` (smoothed points) at the
    update before. A reset means that these are to be forgotten."""
    frames = keypoints.select(*FRAME).distinct().withColumn("before", F.lag("frame_idx").over(Window.partitionBy("game_id").orderBy("frame_idx")))
    was = last_good.where(inner(cfg)).select("game_id", F.col("frame_idx").alias("before"), "kp_idx", F.col("x").alias("bx"), F.col("y").alias("by"))
    both = keypoints.where(inner(cfg)).join(frames, list(FRAME)).join(was, ["game_id", "before", "kp_idx"])
    moved = distance((F.col("x"), F.col("y")), (F.col("bx"), F.col("by"))) > cfg.jump_reset_px
    return both.groupBy(*FRAME).agg(F.count("*").alias("n_matched"), F.count_if(moved).alias("n_moved")).withColumn("reset", F.col("n_moved") > cfg.jump_reset_share * F.col("n_matched"))


def carried(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The last good position within the carry limit, without smoothing: a window over good updates. `age` counts updates."""
    own = per_point()
    rows = keypoints.withColumn("_n", F.row_number().over(own))
    good = F.when(F.col("x").isNotNull(), F.struct("_n", "x", "y"))
    last = rows.withColumn("g", F.last(good, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("age", F.col("_n") - F.col("g._n"))
    near = F.col("age") <= cfg.carry_updates
    return last.select(*FRAME, "kp_idx", F.when(near, F.col("g.x")).alias("x"), F.when(near, F.col("g.y")).alias("y"), "age")


def hold(per_frame: DataFrame, updates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Sample and hold: each frame sees the update of the last even frame."""
    k = updates.withColumnRenamed("frame_idx", "update_frame")
    return per_frame.withColumn("update_frame", F.col("frame_idx") - F.col("frame_idx") % cfg.keypoint_every).join(k, ["game_id", "update_frame"])


def side_state(sides: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The court side over updates (frame_idx, side, accepted: whether a homography was accepted), with hysteresis.

    An accepted homography sets the side to that observed, left or right, at once. Otherwise another side must be observed a number of
    updates in a row before it holds, and only where one holds already; the centre, no side, or the side that holds end the count. A switch
    asks for a new homography (`reseed`, until one is accepted) and begins a transition of some updates. One game's updates are one fold."""
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", "side", "accepted")))
    names = ("frame_idx", "state", "pending", "streak", "transition", "reseed", "switched")
    item = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, names)))

    def add(last: Column, p: Column) -> Column:
        side, held = p["side"], last["state"]
        ends = F.coalesce(~side.isin("left", "right") | (side == held), side.isNull())
        streak = F.when(ends, 0).when(F.coalesce(side == last["pending"], F.lit(False)), last["streak"] + 1).otherwise(1)
        turn = held.isNotNull() & (streak >= cfg.hysteresis)
        at_once = p["accepted"] & F.coalesce(side.isin("left", "right"), F.lit(False))
        state = F.when(at_once | turn, side).otherwise(held)
        left = F.greatest(F.lit(0), F.when(turn, cfg.transition_updates).otherwise(last["transition"]) - 1)
        pending = F.when(ends | turn, F.lit(None).cast("string")).otherwise(side)
        return item(p["frame_idx"], state, pending, F.when(turn, 0).otherwise(streak), left, ~p["accepted"] & (turn | last["reseed"]), turn)

    none = F.lit(None).cast("string")
    start = lambda p: add(item(p["frame_idx"], none, none, F.lit(0), F.lit(0), F.lit(False), F.lit(False)), p)
    return sides.groupBy("game_id").agg(seq.alias("s")).select("game_id", F.inline(running(F.col("s"), start, add)))


def pan_state(priors: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The camera's pan over updates (frame_idx, dx, conf): sure updates are blended into a sure state or replace another; unsure ones let
    it decay to nothing."""
    seq = F.array_sort(F.collect_list(F.struct("frame_idx", F.col("dx").cast("double").alias("dx"), F.col("conf").cast("double").alias("conf"))))
    item = lambda f, d, c: F.struct(f.alias("frame_idx"), d.alias("pan_dx"), c.alias("pan_conf"))

    def add(last: Column, p: Column) -> Column:
        sure, was = p["conf"] >= cfg.pan_min_conf, last["pan_conf"] >= cfg.pan_min_conf
        mixed = F.when(was, last["pan_dx"] * cfg.pan_keep + p["dx"] * (1 - cfg.pan_keep)).otherwise(p["dx"])
        faded = last["pan_dx"] * cfg.pan_decay
        gone = F.abs(faded) < 0.05
        return item(p["frame_idx"], F.when(sure, mixed).when(gone, 0.0).otherwise(faded), F.when(sure, p["conf"]).when(gone, 0.0).otherwise(last["pan_conf"] * cfg.pan_decay))

    sure = lambda p: p["conf"] >= cfg.pan_min_conf
    folded = running(F.col("s"), lambda p: item(p["frame_idx"], F.when(sure(p), p["dx"]).otherwise(0.0), F.when(sure(p), p["conf"]).otherwise(0.0)), add)
    return priors.groupBy("game_id").agg(seq.alias("s")).select("game_id", F.inline(folded))
