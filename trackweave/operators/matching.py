"""Per-frame joins: overlapping pairs, track candidates, nearest and containing boxes, conflicts.

Every join has the equality key (game_id, frame), so distance and overlap are residual predicates of a hash or merge join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.geometry import MILLI_SHIFT, box, box_distance, iou, iou_tlwh

FRAME, TRACK = ("game_id", "frame_idx"), ("game_id", "is_referee", "track_id")
BOX = ("x1", "y1", "x2", "y2")
#: Interval joins are equality joins on spans of so many frames.
SPAN = 16


def renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = FRAME) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keep else f"{prefix}{c}") for c in df.columns))


def is_ref(cfg: Config = DEFAULT) -> Column:
    return F.col("class_id") == cfg.referee_class


def targets(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players and referees, with their role."""
    return detections.where(F.col("class_id").isin(*cfg.player_classes, cfg.referee_class)).withColumn("is_referee", is_ref(cfg))


def iou_pairs(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pairs of detections of a frame whose overlap reaches the threshold of their roles."""
    t = targets(detections, cfg).select(*FRAME, "det_id", "is_referee", "x1", "y1", "x2", "y2")
    pairs = renamed(t, "a_").join(renamed(t, "b_"), list(FRAME)).where("a_det_id < b_det_id")
    same = F.col("a_is_referee") == F.col("b_is_referee")
    return pairs.withColumn("iou", iou(box("a_"), box("b_"))).where(F.col("iou") >= F.when(same, cfg.same_role_iou).otherwise(cfg.cross_role_iou))


def known(tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Each row of a track with the frames (`since` to `upto`) before which it is the track's last: up to the frame in which the track is seen again,
    or in which it has been removed, for it is kept as lost for `buffer` frames."""
    end = F.col("frame_idx") + cfg.buffer + 1
    again = F.lead("frame_idx").over(Window.partitionBy(*TRACK).orderBy("frame_idx"))
    return tracks.select(*TRACK, F.col("frame_idx").alias("seen"), (F.col("frame_idx") + 1).alias("since"), F.least(end, F.coalesce(again, end)).alias("upto"), *BOX)


def spans(low: Column, high: Column) -> Column:
    """All spans that an interval of frames touches."""
    return F.explode(F.sequence(F.floor(low / SPAN), F.floor(high / SPAN)))


def candidates(detections: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks that each detection may continue, ranked: active ones (seen in the frame before) by overlap, and lost ones, as long as they are
    kept, by overlap or distance. Each track stands where it was last seen before the frame."""
    last = known(tracks, cfg).select("game_id", "is_referee", F.col("track_id"), "since", "upto", *(F.col(c).alias(f"t_{c}") for c in BOX)).withColumn("span", spans(F.col("since"), F.col("upto")))
    d = targets(detections, cfg).select(*FRAME, "det_id", "is_referee", *BOX, F.floor(F.col("frame_idx") / SPAN).alias("span"))
    both = d.join(last, ["game_id", "is_referee", "span"]).where("frame_idx BETWEEN since AND upto")
    # Only boxes that touch, or whose centres (doubled here) are near, can match; the costly numbers are made once, of these, beyond the join.
    dx, dy = (F.col(f"{c}1") + F.col(f"{c}2") - F.col(f"t_{c}1") - F.col(f"t_{c}2") for c in "xy")
    touch = (F.col("x1") < F.col("t_x2")) & (F.col("t_x1") < F.col("x2")) & (F.col("y1") < F.col("t_y2")) & (F.col("t_y1") < F.col("y2"))
    both = both.where(touch | (dx * dx + dy * dy <= int((2 * cfg.lost_dist) ** 2) + 1))
    both = both.select("*", F.inline(F.array(F.struct(iou(box(), box("t_")).alias("iou"), box_distance(box(), box("t_")).alias("dist")))))
    active = F.col("frame_idx") == F.col("since")
    both = both.where(F.when(active, F.col("iou") >= cfg.active_iou).otherwise((F.col("iou") >= cfg.lost_iou) | (F.col("dist") <= cfg.lost_dist)))
    score = F.col("iou") + F.when(active, 0.25).otherwise(0.0) - F.least("dist", F.lit(500.0)) / 5000.0
    rank = F.row_number().over(Window.partitionBy(*FRAME, "det_id").orderBy(F.col("score").desc(), "state", "track_id"))
    found = both.withColumn("state", F.when(active, "active").otherwise("lost")).withColumn("score", score).withColumn("rank", rank)
    return found.select(*FRAME, "det_id", "is_referee", "track_id", "state", "iou", "dist", "score", "rank")


def nearest_track(detections: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return candidates(detections, tracks, cfg).where("rank = 1")


def candidate_text(detections: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """The best candidates of each target in one line: `[id:state:iou=0.00:d=0,...]`, `[]` without any. Numbers are cut beside decimal midpoints."""
    cents, whole = F.floor(F.col("iou") * 100 + MILLI_SHIFT), F.floor(F.col("dist") + MILLI_SHIFT)
    one = F.format_string("%d:%s:iou=%d.%02d:d=%d", F.col("track_id"), F.col("state"), F.floor(cents / 100), cents % 100, whole)
    lines = found.where(F.col("rank") <= most).groupBy(*FRAME, "det_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))).alias("all"))
    text = F.concat(F.lit("["), F.array_join(F.transform("all", lambda v: v["s"]), ","), F.lit("]"))
    return targets(detections).select(*FRAME, "det_id").join(lines, [*FRAME, "det_id"], "left").select(*FRAME, "det_id", F.coalesce(text, F.lit("[]")).alias("candidates"))


def source_match(tracks: DataFrame, detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The detection of a track's role that overlaps it most, without a minimum; a track of a frame without any gets class 3."""
    d = targets(detections, cfg).select(*FRAME, "is_referee", "det_id", "class_id", *(F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")))
    both = tracks.join(d, [*FRAME, "is_referee"], "left").withColumn("iou", F.coalesce(iou(box(), box("d_")), F.lit(0.0)))
    best = F.row_number().over(Window.partitionBy(*FRAME, "is_referee", "track_id").orderBy(F.col("iou").desc(), F.col("det_id").asc_nulls_last()))
    return both.withColumn("_n", best).where("_n = 1").select(*FRAME, "is_referee", "track_id", "det_id", F.coalesce("class_id", F.lit(3)).alias("class_id"), "iou")


def near_track(detections: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Player detections close to a player track of the frame before."""
    t = tracks.where("NOT is_referee").select("game_id", (F.col("frame_idx") + 1).alias("frame_idx"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2"))).alias("t")
    d = detections.where(F.col("class_id").isin(*cfg.player_classes)).alias("d")
    b, o = (tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")) for p in ("d.", "t.t_"))
    close = (iou(b, o) >= cfg.near_iou) | (box_distance(b, o) <= cfg.near_dist)
    return d.join(t, (F.col("d.game_id") == F.col("t.game_id")) & (F.col("d.frame_idx") == F.col("t.frame_idx")) & close, "left_semi")


def number_boxes(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return detections.where((F.col("class_id") == cfg.number_class) & (F.col("confidence") >= cfg.number_conf) & (wide >= cfg.number_size) & (high >= cfg.number_size))


def containing_track(numbers: DataFrame, tracks: DataFrame) -> DataFrame:
    """The first track of the frame whose box holds the centre of a number box, in order of observation."""
    n = numbers.select(*FRAME, F.col("det_id"), F.floor((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.floor((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    both = n.join(tracks.where("NOT is_referee"), list(FRAME)).where("cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2")
    first = F.row_number().over(Window.partitionBy(*FRAME, "det_id").orderBy("obs_id"))
    return both.withColumn("_n", first).where("_n = 1").select(*FRAME, "det_id", "cx", "cy", "track_id")


def funnel(detections: DataFrame, stages: list[DataFrame], names: tuple[str, ...], cfg: Config = DEFAULT) -> DataFrame:
    """Per frame and role: detections with their score tiers, and how many rows reach each further stage. Each table of `stages` has the columns of those
    names that it tells of, as flags: one pass over it counts them all."""
    key, conf = [*FRAME, "is_referee"], F.col("confidence")
    flag = lambda rows, n: (F.col(n) if n in rows.columns else F.lit(False)).alias(n)
    rows = targets(detections, cfg).select(*key, F.lit(True).alias("raw"), *(F.lit(False).alias(n) for n in names), "confidence")
    for some in stages:
        rows = rows.unionByName(some.select(*key, F.lit(False).alias("raw"), *(flag(some, n) for n in names), F.lit(None).cast("double").alias("confidence")))
    tiers = (F.count_if(conf >= cfg.high_score).alias("n_high"), F.count_if((conf >= cfg.low_score) & (conf < cfg.high_score)).alias("n_low"))
    return rows.groupBy(*key).agg(*(F.count_if(n).alias(f"n_{n}") for n in ("raw", *names)), *tiers, F.min("confidence").alias("min_score"), F.max("confidence").alias("max_score"))


def as_tlwh(prefix: str = "") -> tuple[Column, ...]:
    a = box(prefix)
    return a[0], a[1], a[2] - a[0], a[3] - a[1]


def blockers(tracks: DataFrame, births: DataFrame, owners: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """For each track the other track of its frame and role that stands most in the way of a mask of its own: one that has a mask or is
    old, and overlaps it or is near, by a distance that grows with size. Of equals the first observed."""
    age = F.greatest(F.lit(0), F.col("frame_idx") - F.coalesce("birth_frame", "frame_idx"))
    masked = owners.select(*FRAME, "track_id", F.lit(True).alias("masked")).distinct()
    t = tracks.join(births.select(*TRACK, "birth_frame"), list(TRACK), "left").join(masked, [*FRAME, "track_id"], "left")
    t = t.select(*FRAME, "is_referee", "track_id", "obs_id", *BOX, (F.coalesce("masked", F.lit(False)) | (age >= cfg.old_age)).alias("bars"))
    keep = (*FRAME, "is_referee")
    both = renamed(t, "a_", keep).join(renamed(t, "b_", keep).where("b_bars"), list(keep)).where("a_track_id <> b_track_id")
    limit = F.greatest(F.lit(cfg.block_px), cfg.block_scale * F.greatest(F.col("a_y2") - F.col("a_y1"), F.col("b_y2") - F.col("b_y1")))
    both = both.withColumn("iou", iou_tlwh(as_tlwh("a_"), as_tlwh("b_"))).withColumn("dist", box_distance(box("a_"), box("b_"))).withColumn("limit", limit)
    both = both.where((F.col("iou") >= cfg.block_iou) | (F.col("dist") <= F.col("limit")))
    power = F.greatest(F.col("iou") / cfg.block_iou, F.col("limit") / F.greatest("dist", F.lit(1.0)))
    best = F.row_number().over(Window.partitionBy(*keep, "a_track_id").orderBy(F.col("power").desc(), "b_obs_id"))
    return both.withColumn("power", power).withColumn("_n", best).where("_n = 1").select(*keep, F.col("a_track_id").alias("track_id"), F.col("b_track_id").alias("by_track"), "iou", "dist")
