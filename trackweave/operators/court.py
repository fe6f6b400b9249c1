"""Court geometry: projection of points, keypoint-weighted projection, boundaries, sides, and comparisons of homographies.

A keypoint that is missing has NULL for x and y; one with a coordinate of 0 or less counts as missing too. Groups of keypoints are
those of `sources.court_template`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.geometry import distance, interpolate, on_court, project, sample_points, sample_shift
from trackweave.operators.matching import FRAME
from trackweave.sources import court_template as T

#: A homography for fixed projections, row by row.
FIXED_H = [0.21, 0.05, -12.0, 0.01, 0.33, -20.0, 0.0001, 0.0003, 1.0]
OTHER_H = [0.20, 0.06, -10.0, 0.015, 0.32, -18.0, 0.0001, 0.0002, 1.0]
#: Groups of keypoints that stand in a line across the court.
LINES = (T.LEFT, T.CENTER, T.LEFT_INNER, T.RIGHT, T.RIGHT_INNER)


def seen() -> Column:
    """Whether a keypoint isn't missing."""
    return F.coalesce((F.col("x") > 0) & (F.col("y") > 0), F.lit(False))


def legacy_index(keypoints: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keypoints with the index of another model by label (-1: none); the mapping has a row for each of the fixed labels."""
    return keypoints.join(F.broadcast(mapping), "label", "left").withColumn("legacy_idx", F.coalesce("legacy_idx", F.lit(-1)))


def projected(points: DataFrame, h: list[float]) -> DataFrame:
    x, y = project(F.col("x"), F.col("y"), h)
    return points.withColumn("tx", x).withColumn("ty", y)


def weighted_projection(points: DataFrame, keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each point's court position from the nearest keypoints of its frame: weights fall with distance and rise with confidence. The
    position is held within the court.

    Keypoints are an array of their frame, at most some tens, which its points meet; each point sorts it by distance. Fewer than two give no row."""
    k = keypoints.where(seen()).groupBy(*FRAME).agg(F.collect_list(F.struct("kp_idx", "x", "y", "conf", "tx", "ty")).alias("_ks"))
    k = k.where(F.size("_ks") >= cfg.relative_min)
    far = lambda p: distance((F.col("x"), F.col("y")), (p["x"], p["y"]))
    by = F.transform("_ks", lambda p: F.struct(far(p).alias("d"), p["kp_idx"].alias("i"), p["conf"].alias("conf"), p["tx"].cast("double").alias("tx"), p["ty"].cast("double").alias("ty")))
    weight = lambda p: F.pow(p["d"] + 1, F.lit(-cfg.neighbour_power)) * F.least(F.greatest(p["conf"], F.lit(cfg.conf_floor)), F.lit(1.0))
    near = F.transform(F.slice(F.array_sort(by), 1, cfg.neighbours), lambda p: F.struct(weight(p).alias("w"), p["tx"].alias("tx"), p["ty"].alias("ty")))
    add = lambda c: F.aggregate("_near", F.lit(0.0), lambda s, p: s + p["w"] * (p[c] if c else F.lit(1.0)))
    both = points.join(k, list(FRAME)).withColumn("_near", near)
    mean = lambda c, size: on_court(add(c) / add(""), size).alias(c)
    return both.select(*FRAME, "point_id", F.size("_near").cast("long").alias("n"), mean("tx", cfg.court_w), mean("ty", cfg.court_h))


def boundaries(keypoints: DataFrame) -> DataFrame:
    """Per frame: the left and right line's points in order of y, and the least y of the top points (or else of all that aren't inner ones)
    and the greatest y of the bottom points. Frames without a keypoint give no row."""
    k = keypoints.where(seen())
    p, i = F.struct(F.col("y").cast("double").alias("y"), "kp_idx", F.col("x").cast("double").alias("x")), F.col("kp_idx")
    line = lambda group: F.array_sort(F.collect_list(F.when(i.isin(*group), p)))
    top, outer = F.min(F.when(i.isin(*T.TOP), F.col("y"))), F.min(F.when(~i.isin(*T.LEFT_INNER, *T.RIGHT_INNER), F.col("y")))
    return k.groupBy(*FRAME).agg(line(T.LEFT).alias("left"), line(T.RIGHT).alias("right"), F.coalesce(top, outer).alias("top"), F.max(F.when(i.isin(*T.BOTTOM), F.col("y"))).alias("bottom"))


def inside_boundaries(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Boxes with `inside`: not wholly left of the left line or right of the right line at their centre's height, nor wholly above the top, nor
    reaching below the bottom; a side without keypoints bars nothing."""
    both = boxes.join(bounds, list(FRAME), "left")
    cy = (F.col("y1") + F.col("y2")) * 0.5
    past = lambda line, out: F.coalesce((F.size(line) > 0) & out, F.lit(False))
    out = past("left", F.col("x2") < interpolate(cy, F.col("left"))) | past("right", F.col("x1") > interpolate(cy, F.col("right")))
    out = out | F.coalesce(F.col("y2") < F.col("top"), F.lit(False)) | F.coalesce(F.col("y2") > F.col("bottom"), F.lit(False))
    return both.withColumn("inside", ~out).drop("left", "right", "top", "bottom")


def keep_on_court(detections: DataFrame, bounds: DataFrame, near: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Detections that aren't players, stand on the court, or are near a track of the frame before."""
    close = near.select(*FRAME, "det_id", F.lit(True).alias("_near")).distinct()
    flagged = inside_boundaries(detections, bounds).join(close, [*FRAME, "det_id"], "left")
    return flagged.where(~F.col("class_id").isin(*cfg.player_classes) | F.col("inside") | F.col("_near")).select(*detections.columns)


def side_of(mean: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(mean < cfg.side_low * cfg.court_w, "left").when(mean > cfg.side_high * cfg.court_w, "right").when(mean.isNotNull(), "center")


def layout_side(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per frame with pairs: the median slope between keypoints of one line, and the side that it says where it is steep enough."""
    line = F.lit(None).cast("int")
    for k, group in enumerate(LINES):
        line = F.when(F.col("kp_idx").isin(*group), k).otherwise(line)
    good = keypoints.where(seen() & (F.col("conf") >= cfg.slope_conf)).select(*FRAME, line.alias("line"), F.col("kp_idx").alias("i"), "x", "y").where("line IS NOT NULL")
    points = good.groupBy(*FRAME).agg(F.collect_list(F.struct("line", "i", "x", "y")).alias("ps"))
    partner = lambda a: lambda b: (b["line"] == a["line"]) & (b["i"] > a["i"]) & (F.abs(b["y"] - a["y"]) >= cfg.slope_dy)
    slope = lambda a: lambda b: (b["x"] - a["x"]).cast("double") / (b["y"] - a["y"])
    slopes = F.array_sort(F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", partner(a)), slope(a)))))
    per = points.select(*FRAME, slopes.alias("s")).where(F.size("s") >= cfg.slope_pairs).withColumn("n_pairs", F.size("s").cast("long"))
    middle = (F.get("s", F.floor((F.col("n_pairs") - 1) / 2).cast("int")) + F.get("s", F.floor(F.col("n_pairs") / 2).cast("int"))) / 2
    per = per.select(*FRAME, "n_pairs", middle.alias("slope"))
    return per.withColumn("side", F.when(F.abs("slope") < cfg.slope_min, F.lit(None)).when(F.col("slope") < 0, "left").otherwise("right"))


def observed_side(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per frame: counts of keypoints of the left, centre and right groups, the layout's side, the centre line's x, and the side observed.

    That is the layout's, or else by where the centre line stands in the frame (now, or when it was last looked at), or else by the
    counts with a margin."""
    good, i = seen() & (F.col("conf") >= cfg.keypoint_conf), F.col("kp_idx")
    count = lambda *groups: F.count_if(good & i.isin(*(k for g in groups for k in g)))
    center = F.avg(F.when(good & i.isin(*T.CENTER), F.col("x").cast("double")))
    per = keypoints.groupBy(*FRAME).agg(count(T.LEFT, T.LEFT_INNER).alias("n_left"), count(T.CENTER).alias("n_center"), count(T.RIGHT, T.RIGHT_INNER).alias("n_right"), center.alias("center_x"))
    per = per.join(layout_side(keypoints, cfg).select(*FRAME, F.col("side").alias("layout")), list(FRAME), "left")
    per = carried_center(per)
    share, held = F.col("center_x") / cfg.frame_w, F.col("last_center") / cfg.frame_w
    by_center = F.when(share < cfg.center_band, "right").when(share > 1.0 - cfg.center_band, "left").otherwise("center")
    ahead = lambda a, b: (F.col(a) >= cfg.side_min) & (F.col(a) >= F.col(b) + cfg.side_margin)
    by_count = F.when(ahead("n_right", "n_left"), "right").when(ahead("n_left", "n_right"), "left")
    by_held = F.when(held < 0.5, "right").otherwise("left")
    side = F.when(F.col("layout").isNotNull(), F.col("layout")).when(share.isNotNull(), by_center).when(held.isNotNull(), by_held).otherwise(by_count)
    return per.withColumn("side", side)


def carried_center(per_frame: DataFrame) -> DataFrame:
    """Frames (layout, center_x) with `last_center`: the centre line's x when it was last looked at, up to this frame, in its game. It is looked
    at only in frames whose layout says no side."""
    order = Window.partitionBy("game_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return per_frame.withColumn("last_center", F.last(F.when(F.col("layout").isNull(), F.col("center_x")), ignorenulls=True).over(order))


def reprojection(matched: DataFrame, h: list[float]) -> DataFrame:
    """Per frame: matched keypoints, and the median distance between their images under h and the template; of under four, none."""
    x, y = project(F.col("x"), F.col("y"), h)
    errors = matched.where(seen()).withColumn("err", distance((x, y), (F.col("tx"), F.col("ty"))))
    return errors.groupBy(*FRAME).agg(F.count("*").alias("n"), F.median("err").alias("median_err")).withColumn("median_err", F.when(F.col("n") >= 4, F.col("median_err")))


def without_outliers(matched: DataFrame, h: list[float], limit: float) -> DataFrame:
    x, y = project(F.col("x"), F.col("y"), h)
    return matched.where(distance((x, y), (F.col("tx"), F.col("ty"))) <= limit)


def homography_shift(frames: DataFrame, h: list[float], g: list[float], cfg: Config = DEFAULT) -> DataFrame:
    """Mean and greatest shift of nine sample points between two homographies, for each row."""
    lit = lambda m: [F.lit(float(v)) for v in m]
    mean, most = sample_shift(lit(h), lit(g), sample_points(cfg))
    return frames.withColumn("mean_shift", mean).withColumn("max_shift", most)


def pan_prior(keypoints: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per update: keypoints seen surely in it and the update before, the median of their shifts in x, its median absolute deviation, the
    confidence that the camera pans, and the court pixels a frame that it does (0 where it isn't sure).

    Too few points, or a shift too small, have confidence 0; else it is the share that shift the median's way times how little they
    deviate."""
    good = keypoints.where(seen() & (F.col("conf") >= cfg.geometry_conf)).select("game_id", "frame_idx", "kp_idx", "x")
    frames = keypoints.select(*FRAME).distinct().withColumn("before", F.lag("frame_idx").over(Window.partitionBy("game_id").orderBy("frame_idx")))
    was = good.select("game_id", F.col("frame_idx").alias("before"), "kp_idx", F.col("x").alias("bx"))
    d = good.join(frames, list(FRAME)).join(was, ["game_id", "before", "kp_idx"]).select(*FRAME, (F.col("x") - F.col("bx")).cast("double").alias("dx"))
    med = d.groupBy(*FRAME).agg(F.median("dx").alias("med"))
    both = d.join(med, list(FRAME)).groupBy(*FRAME).agg(
        F.first("med").alias("med"), F.count("*").alias("n"), F.median(F.abs(F.col("dx") - F.col("med"))).alias("mad"),
        F.avg((F.signum("dx") == F.when(F.col("med") > 0, 1.0).otherwise(-1.0)).cast("double")).alias("agree"),
    )
    per = frames.join(both, list(FRAME), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    moved = (F.col("n") >= cfg.pan_min_points) & (F.abs("med") >= cfg.pan_min_px)
    conf = F.when(moved, F.col("agree") * F.greatest(F.lit(0.0), 1.0 - F.col("mad") / cfg.pan_max_mad)).otherwise(0.0)
    per = per.withColumn("conf", F.coalesce(conf, F.lit(0.0)))
    sure = moved & (F.col("mad") <= cfg.pan_max_mad) & (F.col("conf") >= cfg.pan_min_conf)
    dx = F.when(sure, -(F.col("med") / F.greatest(F.lit(1), F.col("frame_idx") - F.col("before"))) * (float(cfg.court_w) / cfg.frame_w) * cfg.pan_gain).otherwise(0.0)
    return per.withColumn("dx", F.coalesce(dx, F.lit(0.0))).drop("before", "agree")


def template_mode(layout: Column, court_side: Column, normal_mean: Column, last_mode: Column, cfg: Config = DEFAULT) -> Column:
    """Which template a frame's keypoints go to: the one whose side is the wanted one (of the layout, or else of the court), else the last.

    `normal_mean` is the mean court x of the keypoints under the normal template; the mirrored one has it from the other end."""
    want = F.coalesce(layout, court_side)
    normal, mirrored = side_of(normal_mean, cfg), side_of(F.lit(cfg.court_w) - normal_mean, cfg)
    return F.when(want.isin("left", "right") & (normal == want), "normal").when(want.isin("left", "right") & (mirrored == want), "mirrored").otherwise(F.coalesce(last_mode, F.lit("normal")))


