"""Greedy suppression within a frame, as a native fold: rows are sorted by priority, and each is kept unless a kept one bars it.

A frame holds some tens of boxes, so its array is small whatever the table's size; frames are spread by (game_id, frame_idx). The fold asks kept
rows only. Joining all pairs of a frame first and folding over flags was measured at twice to four times the time, for it reads its input three times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config
from trackweave.functions.geometry import box_distance, distance, iou, iou_tlwh, of_struct
from trackweave.operators.matching import FRAME, candidates, targets

Bars = Callable[[Column, Column], Column]


def arrays(rows: DataFrame, order: list[Column], fields: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Each group's rows as an array of structs in `order`, which comes first in them."""
    item = F.struct(*(o.alias(f"_o{k}") for k, o in enumerate(order)), *fields)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))


def none_of(items: str) -> Column:
    return F.filter(items, lambda _: F.lit(False))


def judged(rows: DataFrame, order: list[Column], fields: list[str], bars: Bars, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """All rows of each group, with `by`, the first kept row that bars them, as a struct; NULL for those that are kept themselves.

    `bars(kept, row)` says whether a kept row suppresses another."""
    grouped = arrays(rows, order, [f for f in fields if f not in keys], keys)
    start = F.struct(none_of("_all").alias("kept"), F.array().cast("array<int>").alias("by"))

    def add(acc: Column, x: Column) -> Column:
        by = F.get(F.filter(F.transform(acc["kept"], lambda k, i: F.when(bars(k, x), i)), lambda i: i.isNotNull()), F.lit(0))
        return F.struct(F.when(by.isNull(), F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), F.concat(acc["by"], F.array(by)).alias("by"))

    out = grouped.select(*keys, "_all", F.aggregate("_all", start, add).alias("_r"))
    out = out.select(*keys, "_r.kept", F.inline(F.arrays_zip("_all", F.col("_r.by").alias("_by"))))
    return out.select(*keys, F.get("kept", F.col("_by")).alias("by"), *(F.col(f"_all.{c}").alias(c) for c in fields if c not in keys))


def greedy(rows: DataFrame, order: list[Column], fields: list[str], bars: Bars, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Rows of each group that survive."""
    kept = F.aggregate("_all", none_of("_all"), lambda acc, x: F.when(F.exists(acc, lambda k: bars(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return arrays(rows, order, fields, keys).select(*keys, F.explode(kept).alias("_k")).select(*keys, *(F.col(f"_k.{c}").alias(c) for c in fields))


def _roles(k: Column, x: Column, same: float, cross: float, bypass: Column | None = None) -> Column:
    v = iou(of_struct(k), of_struct(x))
    alike = k["is_referee"] == x["is_referee"]
    hit = v >= same if bypass is None else (v >= same) & ~bypass
    return F.when(alike, hit).otherwise(v >= cross)


BOX = ["x1", "y1", "x2", "y2"]


def by_confidence(cfg: Config = DEFAULT) -> tuple[list[Column], list[str], Bars]:
    """Priority of detections by confidence (ties by position), the columns that go with them, and what bars one."""
    fields = ["det_id", "is_referee", "class_id", "confidence", *BOX]
    return [-F.col("confidence"), F.col("det_id")], fields, lambda k, x: _roles(k, x, cfg.same_role_iou, cfg.cross_role_iou)


def suppress_detections(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players and referees left after suppression in order of confidence."""
    return greedy(targets(detections, cfg), *by_confidence(cfg))


def judged_detections(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Players and referees, and whether suppression in order of confidence has `kept` them."""
    return judged(targets(detections, cfg), *by_confidence(cfg)).withColumn("kept", F.col("by").isNull())


def aged(found: DataFrame, births: DataFrame) -> DataFrame:
    """Candidates with their tracks' ages; a track without a known birth, or born later, has age 0."""
    b = births.select("game_id", "is_referee", "track_id", "birth_frame")
    return found.join(b, ["game_id", "is_referee", "track_id"], "left").withColumn("age", F.greatest(F.lit(0), F.col("frame_idx") - F.coalesce("birth_frame", "frame_idx")))


def with_candidates(detections: DataFrame, tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Targets with their two best candidates (columns t1, t2: track, s1, s2: score, a1, a2: age; NULL where there is none)."""
    found = aged(candidates(detections, tracks, cfg).where("rank <= 2"), births)
    of = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    two = found.groupBy(*FRAME, "det_id").agg(*(of(n, c).alias(f"{a}{n}") for n in (1, 2) for a, c in (("t", "track_id"), ("s", "score"), ("a", "age"))))
    return targets(detections, cfg).join(two, [*FRAME, "det_id"], "left")


CANDS = ["t1", "s1", "a1", "t2", "s2", "a2"]


def young_pair(a: Column, b: Column, cfg: Config = DEFAULT) -> Column:
    """Whether one age is young and the other established."""
    return ((a <= cfg.young_age) & (b >= cfg.old_age)) | ((b <= cfg.young_age) & (a >= cfg.old_age))


def continues_others(x: Column, k: Column, cfg: Config = DEFAULT) -> Column:
    """Whether a row and a kept row of its role continue different tracks, neither young beside an established one.

    The pair of different tracks with the greatest sum of scores counts; the first in order of the row's candidates, then the kept row's,
    of equals. If the best candidates differ, it is these; else one of them with the other's second best: no other can be better."""
    differ = F.coalesce(x["t1"] != k["t1"], F.lit(False))
    theirs, own = x["s1"] + k["s2"], x["s2"] + k["s1"]
    second = F.coalesce(theirs >= own, theirs.isNotNull())
    ages = lambda a, b: ~young_pair(a, b, cfg)
    some = x["t1"].isNotNull() & k["t1"].isNotNull()
    return some & F.when(differ, ages(x["a1"], k["a1"])).when(second, ages(x["a1"], k["a2"])).when(own.isNotNull(), ages(x["a2"], k["a1"])).otherwise(F.lit(False))


def by_track(cfg: Config = DEFAULT) -> tuple[list[Column], Callable[[Column, Column], Column]]:
    """Priority of detections by (age of the matched track, confidence), and what bars one."""
    order = [-F.least(F.coalesce("a1", F.lit(0)), F.lit(cfg.max_age_key)), -F.col("confidence"), F.col("det_id")]
    return order, lambda k, x: _roles(k, x, cfg.same_role_iou, cfg.cross_role_iou, continues_others(x, k, cfg))


def suppress_detections_by_track(detections: DataFrame, tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Suppression in order of (age of the matched track, confidence). Two detections of one role that continue different tracks are
    both kept, unless one of these tracks is young and the other established."""
    order, bars = by_track(cfg)
    return greedy(with_candidates(detections, tracks, births, cfg), order, ["det_id", "is_referee", "class_id", "confidence", *CANDS, *BOX], bars).drop(*CANDS)


def tracked_ledger(detections: DataFrame, tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(frame, det_id, by_det, dropped_id, kept_id): each detection that suppression by track drops, the kept one that bars it, and the
    tracks that both would continue best (NULL: none)."""
    order, bars = by_track(cfg)
    gone = judged(with_candidates(detections, tracks, births, cfg), order, ["det_id", "is_referee", *CANDS, *BOX], bars).where("by IS NOT NULL")
    return gone.select(*FRAME, "det_id", F.col("by.det_id").alias("by_det"), F.col("t1").alias("dropped_id"), F.col("by.t1").alias("kept_id"))


def with_births(tracks: DataFrame, births: DataFrame) -> DataFrame:
    b = births.select("game_id", "is_referee", "track_id", "birth_frame", "birth_x", "birth_y")
    return tracks.join(b, ["game_id", "is_referee", "track_id"]).withColumn("age", F.greatest(F.lit(0), F.col("frame_idx") - F.col("birth_frame")))


def suppress_tracks(tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks left after suppression in order of (age, confidence). Tracks of one role that were born apart in time or place are both
    kept, unless a young one lies on an established one."""
    return greedy(with_births(tracks, births), *by_age(cfg))


def judged_tracks(tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """All tracks, and whether suppression has `kept` them."""
    return judged(with_births(tracks, births), *by_age(cfg)).withColumn("kept", F.col("by").isNull())


def by_age(cfg: Config = DEFAULT) -> tuple[list[Column], list[str], Bars]:
    """Priority of tracks, the columns that go with them, and what bars one."""

    def bypass(k: Column, x: Column) -> Column:
        v = iou(of_struct(k), of_struct(x))
        young = young_pair(k["age"], x["age"], cfg)
        far = distance((k["birth_x"], k["birth_y"]), (x["birth_x"], x["birth_y"])) > cfg.birth_dist
        apart = (k["track_id"] != x["track_id"]) & ((F.abs(k["birth_frame"] - x["birth_frame"]) > cfg.birth_gap) | far)
        return ~(young & (v >= cfg.track_young_iou)) & apart

    fields = ["track_id", "is_referee", "confidence", "age", "birth_frame", "birth_x", "birth_y", *BOX]
    order = [-F.least("age", F.lit(cfg.max_age_key)), -F.col("confidence"), F.col("obs_id")]
    return order, fields, lambda k, x: _roles(k, x, cfg.track_same_iou, cfg.cross_role_iou, bypass(k, x))


def drop_young_overlaps(tracks: DataFrame, births: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Tracks of each role without young ones that lie on, or overlap and stand near, an established kept one."""
    as_tlwh = lambda s: (s["x1"], s["y1"], s["x2"] - s["x1"], s["y2"] - s["y1"])

    def bars(k: Column, x: Column) -> Column:
        v = iou_tlwh(as_tlwh(k), as_tlwh(x))
        near = (v >= cfg.overlap_near_iou) & (box_distance(of_struct(k), of_struct(x)) <= cfg.overlap_near_dist)
        return (x["age"] <= cfg.young_age) & (k["age"] >= cfg.old_age) & ((v >= cfg.overlap_drop_iou) | near)

    order = [-F.least("age", F.lit(cfg.max_age_key)), -F.col("confidence"), F.col("track_id")]
    return greedy(with_births(tracks, births), order, ["track_id", "confidence", "age", *BOX], bars, (*FRAME, "is_referee"))


def suppression_ledger(detections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(frame, dropped_id, kept_id): each detection suppressed in order of confidence, with the first kept one that bars it."""
    t = targets(detections, cfg)
    gone = judged(t, [-F.col("confidence"), F.col("det_id")], ["det_id", "is_referee", *BOX], lambda k, x: _roles(k, x, cfg.same_role_iou, cfg.cross_role_iou))
    return gone.where("by IS NOT NULL").select(*FRAME, F.col("det_id").alias("dropped_id"), F.col("by.det_id").alias("kept_id"))
