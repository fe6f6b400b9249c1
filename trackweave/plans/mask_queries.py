"""Queries of masks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.config import DEFAULT as CFG
from trackweave.functions.geometry import milli
from trackweave.operators import lifecycle, masks
from trackweave.plans import sql as S
from trackweave.plans.detections import DOMINANT, OWNERS, owners
from trackweave.plans.registry import query
from trackweave.sources import tables as T


def _dominant(spark, d):
    return masks.dominant(T.crowd(spark, d), T.mask_runs(spark, d))


@query(f"{DOMINANT} SELECT frame_idx, is_referee, track_id, mask_id, CAST(inside AS BIGINT) AS inside, CAST(wide AS BIGINT) AS wide, CAST(area AS BIGINT) AS area, {S.milli('fill')} AS fill_milli, ok FROM dm")
def mask_dominant(spark, d):
    ok = (F.col("wide") >= CFG.mask_area) & (F.col("inside_ratio") >= CFG.mask_inside)
    return _dominant(spark, d).select("frame_idx", "is_referee", "track_id", "mask_id", "inside", "wide", "area", milli(F.col("fill")).alias("fill_milli"), ok.alias("ok"))


@query(f"""
{DOMINANT}, {S.births('crw')},
q AS (SELECT dm.*, birth_frame FROM dm JOIN births USING (game_id, is_referee, track_id) WHERE ok AND fill >= 0.45),
o AS (SELECT *, first_value(track_id) OVER w AS oid, first_value(x1) OVER w AS ox1, first_value(y1) OVER w AS oy1, first_value(x2) OVER w AS ox2, first_value(y2) OVER w AS oy2
  FROM q WINDOW w AS (PARTITION BY frame_idx, is_referee, mask_id ORDER BY birth_frame, track_id, fill DESC))
SELECT frame_idx, is_referee, track_id FROM crw c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.frame_idx = c.frame_idx AND o.is_referee = c.is_referee AND o.track_id = c.track_id AND o.oid <> o.track_id
  AND NOT ({S.iou('o.', 'o.o')} < 0.5 AND {S.dist('o.', 'o.o')} > 40))
""")
def mask_duplicates(spark, d):
    t = T.crowd(spark, d)
    return masks.without_duplicates(t, masks.dominant(t, T.mask_runs(spark, d)), lifecycle.births(t)).select("frame_idx", "is_referee", "track_id")


@query("""
SELECT frame_idx, mask_id, CAST(sum(x_end - x_start) AS BIGINT) AS area, CAST(floor(CAST(sum((x_end - x_start) * (x_start + x_end - 1)) AS DOUBLE) / (2 * sum(x_end - x_start))) AS BIGINT) AS cx,
  CAST(floor(CAST(sum((x_end - x_start) * y) AS DOUBLE) / sum(x_end - x_start)) AS BIGINT) AS cy FROM mr GROUP BY ALL
""")
def mask_sizes(spark, d):
    return masks.sizes(T.mask_runs(spark, d)).drop("game_id")


#: Over pixels: those at or below the 88th percentile of y; of under four, those up to 3 rows above the last.
@query(f"""
px AS (SELECT frame_idx, mask_id, y, unnest(range(x_start, x_end)) AS x FROM mr),
c AS (SELECT frame_idx, mask_id, quantile_cont(y, 0.88) AS cut, max(y) AS last FROM px GROUP BY ALL),
f AS (SELECT frame_idx, mask_id, count(*) < 4 AS few FROM px JOIN c USING (frame_idx, mask_id) WHERE y >= cut GROUP BY ALL)
SELECT frame_idx, mask_id, count(*) AS n, {S.milli('median(x)')} AS fx_milli, {S.milli('quantile_cont(y, 0.96)')} AS fy_milli FROM px JOIN c USING (frame_idx, mask_id) JOIN f USING (frame_idx, mask_id)
WHERE CASE WHEN few THEN y >= greatest(last - 3, 0) ELSE y >= cut END GROUP BY ALL
""")
def foot_percentile(spark, d):
    return masks.feet(T.mask_runs(spark, d)).select("frame_idx", "mask_id", "n", milli(F.col("fx")).alias("fx_milli"), milli(F.col("fy")).alias("fy_milli"))


@query("""
SELECT a.frame_idx, a.mask_id AS a_mask_id, b.mask_id AS b_mask_id, CAST(sum(least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start)) AS BIGINT) AS shared
FROM mr a JOIN mr b ON a.frame_idx = b.frame_idx AND a.y = b.y AND a.mask_id < b.mask_id AND a.x_start < b.x_end AND b.x_start < a.x_end GROUP BY ALL
""")
def mask_pairs(spark, d):
    return masks.iou_of_masks(T.mask_runs(spark, d)).drop("game_id")


#: Pixel by pixel, the last mask has it; pixels of one mask in a row are a run.
@query("""
px AS (SELECT frame_idx, y, x, max(mask_id) AS mask_id FROM (SELECT frame_idx, y, mask_id, unnest(range(x_start, x_end)) AS x FROM mr) GROUP BY ALL),
g AS (SELECT *, x - row_number() OVER (PARTITION BY frame_idx, y, mask_id ORDER BY x) AS piece FROM px)
SELECT frame_idx, mask_id, y, min(x) AS x_start, max(x) + 1 AS x_end FROM g GROUP BY frame_idx, y, mask_id, piece
""")
def mask_paint(spark, d):
    return masks.painted(T.mask_runs(spark, d)).drop("game_id")


@query(f"""
{OWNERS}, h AS (SELECT t.*, CAST(ow.mask_id IS NOT NULL AS INTEGER) AS has FROM crw t LEFT JOIN ow USING (game_id, frame_idx, track_id)),
g AS (SELECT *, sum(has) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS grp FROM h)
SELECT frame_idx, is_referee, track_id, CAST(sum(1 - has) OVER (PARTITION BY game_id, is_referee, track_id, grp ORDER BY frame_idx) AS BIGINT) AS n_missing FROM g
""")
def mask_missing(spark, d):
    return masks.missing_runs(T.crowd(spark, d), owners(spark, d)).select("frame_idx", "is_referee", "track_id", "n_missing")


#: A mask whose owner isn't in the frame: that of the track two ids on.
_LENT = "ow AS (SELECT game_id, frame_idx, track_id + CASE WHEN obs_id % 2 = 0 THEN 1000 ELSE 0 END AS track_id, obs_id % 1000 + 1 AS mask_id FROM crw WHERE NOT is_referee)"


@query(f"""
{DOMINANT}, {_LENT}
SELECT f.frame_idx, f.track_id, f.mask_id, ow.track_id AS owner_id FROM dm f JOIN ow ON ow.frame_idx = f.frame_idx AND ow.mask_id = f.mask_id WHERE f.ok AND NOT f.is_referee AND f.fill >= 0.35
  AND NOT EXISTS (SELECT 1 FROM ow q WHERE q.frame_idx = f.frame_idx AND q.track_id = f.track_id) AND NOT EXISTS (SELECT 1 FROM crw c WHERE NOT c.is_referee AND c.frame_idx = ow.frame_idx AND c.track_id = ow.track_id)
""")
def mask_reuse(spark, d):
    t = T.crowd(spark, d)
    lent = t.where("NOT is_referee").select("game_id", "frame_idx", (F.col("track_id") + F.when(F.col("obs_id") % 2 == 0, 1000).otherwise(0)).alias("track_id"), (F.col("obs_id") % 1000 + 1).alias("mask_id"))
    return masks.reusable(t, masks.dominant(t, T.mask_runs(spark, d)), lent).select("frame_idx", "track_id", "mask_id", "owner_id")


#: Tracks in runs of frames: each id of ten, in 40 frames of 50.
_RUNS = """rq AS (SELECT f.game_id, f.frame_idx, t.track_id, (f.frame_idx * 7 + t.track_id * 3) % 23 = 0 AS has, (f.frame_idx + t.track_id) % 3 = 1 AS blk, CASE WHEN (f.frame_idx + t.track_id * 9) % 60 < 20 THEN 40 ELSE 400 END AS wide,
  CASE WHEN (f.frame_idx + t.track_id * 9) % 60 < 40 THEN 0.1::double ELSE 0.5::double END AS ratio, (f.frame_idx + t.track_id * 5) % 17 <> 0 AS masked, row_number() OVER (PARTITION BY f.game_id, t.track_id ORDER BY f.frame_idx) AS n
  FROM (SELECT DISTINCT game_id, frame_idx FROM det) f, (SELECT unnest(range(10)) AS track_id) t WHERE (f.frame_idx + t.track_id * 5) % 50 < 40)"""


def _runs_of_tracks(spark, d):
    frames = T.detections(spark, d).select("game_id", "frame_idx").distinct()
    rows = frames.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("track_id")).withColumn("is_referee", F.lit(False))
    f, t = F.col("frame_idx"), F.col("track_id")
    phase = (f + t * 9) % 60
    return rows.where((f + t * 5) % 50 < 40).select(
        "*", ((f * 7 + t * 3) % 23 == 0).alias("has"), ((f + t) % 3 == 1).alias("blocked"), F.when(phase < 20, 40).otherwise(400).alias("wide"), F.when(phase < 40, 0.1).otherwise(0.5).alias("inside_ratio"), ((f + t * 5) % 17 != 0).alias("masked"),
    )


#: A track without a mask for 6 frames in a row asks for one, unless it is blocked (it waits from then on) or rests for 20 frames since it asked; a frame without the track ends count and waiting.
@query(f"""
{_RUNS}, st(game_id, track_id, n, frame_idx, missing, cool, waiting, ask) AS (
SELECT game_id, track_id, n, frame_idx, CASE WHEN has THEN 0 ELSE 1 END, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM rq WHERE n = 1 UNION ALL
SELECT game_id, track_id, n, frame_idx, m, CASE WHEN due AND NOT blk THEN 20 ELSE c END, CASE WHEN has OR (due AND NOT blk) THEN NULL WHEN due THEN coalesce(w, frame_idx) ELSE w END, due AND NOT blk
FROM (SELECT *, NOT has AND c = 0 AND m >= 6 AS due FROM (SELECT *, CASE WHEN has THEN 0 WHEN c > 0 THEN old ELSE old + 1 END AS m FROM (
  SELECT r.game_id, r.track_id, r.n, r.frame_idx, r.has, r.blk, greatest(0, s.cool - (r.frame_idx - s.frame_idx)) AS c, CASE WHEN r.frame_idx = s.frame_idx + 1 THEN s.missing ELSE 0 END AS old,
    CASE WHEN r.frame_idx = s.frame_idx + 1 THEN s.waiting END AS w FROM st s JOIN rq r ON r.game_id = s.game_id AND r.track_id = s.track_id AND r.n = s.n + 1))))
SELECT frame_idx, track_id, CAST(missing AS BIGINT) AS missing, CAST(cool AS BIGINT) AS cooldown, waiting, ask AS request FROM st
""")
def mask_requests(spark, d):
    out = masks.requests(_runs_of_tracks(spark, d).withColumnRenamed("has", "has_mask"))
    return out.select("frame_idx", "track_id", F.col("missing").cast("long").alias("missing"), F.col("cooldown").cast("long").alias("cooldown"), "waiting", "request")


#: A cut mask of under 80 pixels, or with under 35 % of it inside, fails; 4 failures in a row with too few pixels, or 10 with at most 12 % inside, ask for a new one, which then rests for 20 frames.
@query(f"""
{_RUNS}, st(game_id, track_id, n, frame_idx, fails, cool, ask) AS (
SELECT game_id, track_id, CAST(0 AS BIGINT), frame_idx - 1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM rq WHERE n = 1 UNION ALL
SELECT game_id, track_id, n, frame_idx, CASE WHEN due THEN 0 ELSE f END, CASE WHEN due THEN 20 ELSE c END, due
FROM (SELECT *, bad AND c = 0 AND ((wide < 80 AND f >= 4) OR (wide >= 80 AND ratio <= 0.12 AND f >= 10)) AS due FROM (SELECT *, CASE WHEN NOT masked THEN old WHEN bad THEN old + 1 ELSE 0 END AS f FROM (
  SELECT r.game_id, r.track_id, r.n, r.frame_idx, r.wide, r.ratio, r.masked, r.masked AND (r.wide < 80 OR r.ratio < 0.35) AS bad, s.fails AS old, greatest(0, s.cool - (r.frame_idx - s.frame_idx)) AS c
  FROM st s JOIN rq r ON r.game_id = s.game_id AND r.track_id = s.track_id AND r.n = s.n + 1))))
SELECT frame_idx, track_id, fails, cool AS cooldown, ask AS reinit FROM st WHERE n > 0
""")
def mask_cut_failures(spark, d):
    out = masks.cut_failures(_runs_of_tracks(spark, d).withColumn("has_mask", F.col("masked")))
    return out.select("frame_idx", "track_id", "fails", "cooldown", "reinit")
