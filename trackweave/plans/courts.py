"""Queries of projections, keypoints, sides and smoothed positions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.config import DEFAULT as CFG
from trackweave.functions import geometry as G
from trackweave.functions import text as X
from trackweave.functions.geometry import milli
from trackweave.operators import court, homography, keypoints, masks, tactical
from trackweave.plans import sql as S
from trackweave.plans.detections import FIVE, OWNERS, owners
from trackweave.plans.registry import query
from trackweave.sources import scans
from trackweave.sources import tables as T

HL = court.FIXED_H
_X, _Y = S.project("x", "y", HL)


def good_views(spark, d):
    """Views without points at the frame's border."""
    return keypoints.inside_border(T.views(spark, d))


def matched(spark, d):
    return good_views(spark, d).where("x IS NOT NULL").join(F.broadcast(T.template(spark)), "kp_idx")


def _point(name="kp_idx"):
    return F.col(name).cast("long").alias(name)


@query(f"SELECT point_id, {S.milli(_X)} AS tx_milli, {S.milli(_Y)} AS ty_milli, least(greatest(CAST(round_even({_X}, 0) AS BIGINT), 0), 299) AS gx, 300 - x AS mirrored FROM pts")
def project_h(spark, d):
    return court.projected(T.points(spark, d), HL).select("point_id", milli(F.col("tx")).alias("tx_milli"), milli(F.col("ty")).alias("ty_milli"), G.clamp(F.col("tx"), CFG.court_w).alias("gx"), G.mirror_x(F.col("x")).alias("mirrored"))


#: A fourth of the points has no homography, a third no relative point. Inside the court and 25 pixels around it the homography alone
#: counts, held within the court; outside, 15 parts of it and 85 of the relative point; nothing where that is missing.
@query(f"""
p AS (SELECT point_id, CASE WHEN point_id % 4 <> 0 THEN {_X} * 2 END AS tx, CASE WHEN point_id % 4 <> 0 THEN {_Y} END AS ty,
  CASE WHEN point_id % 3 <> 0 THEN CAST(point_id % 300 AS DOUBLE) END AS rx, CASE WHEN point_id % 3 <> 0 THEN CAST(point_id % 161 AS DOUBLE) END AS ry FROM pts),
q AS (SELECT *, tx >= -25 AND tx <= 325 AND ty >= -25 AND ty <= 186 AS h_in, least(greatest(tx, 0), 299) AS hx, least(greatest(ty, 0), 160) AS hy FROM p),
r AS (SELECT *, CASE WHEN tx IS NULL AND rx IS NULL THEN NULL WHEN tx IS NULL THEN 'relative' WHEN rx IS NULL AND NOT h_in THEN NULL WHEN h_in THEN 'H' ELSE 'relative-guard' END AS source FROM q)
SELECT point_id, source, {S.milli("CASE source WHEN 'relative' THEN rx WHEN 'H' THEN hx ELSE least(greatest(hx * (1.0::double - 0.85::double) + rx * 0.85::double, 0), 299) END")} AS x_milli,
  {S.milli("CASE source WHEN 'relative' THEN ry WHEN 'H' THEN hy ELSE least(greatest(hy * (1.0::double - 0.85::double) + ry * 0.85::double, 0), 160) END")} AS y_milli FROM r WHERE source IS NOT NULL
""")
def projection_choice(spark, d):
    p = court.projected(T.points(spark, d), HL)
    pair = lambda cond, x, y: F.when(cond, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    direct = pair(F.col("point_id") % 4 != 0, F.col("tx") * 2, F.col("ty"))
    relative = pair(F.col("point_id") % 3 != 0, F.col("point_id") % 300, F.col("point_id") % 161)
    rows = p.select("point_id", direct.alias("h"), relative.alias("r"))
    out = rows.withColumn("c", G.choose_projection(F.col("r"), F.col("h"))).where("c IS NOT NULL")
    return out.select("point_id", F.col("c.source").alias("source"), milli(F.col("c.x")).alias("x_milli"), milli(F.col("c.y")).alias("y_milli"))


_FOOT = S.project("((x1 + x2) / 2.0::double)", "greatest(y1, y2 - 3)", HL)


@query(f"SELECT frame_idx, is_referee, track_id, {S.milli(_FOOT[0])} AS x_milli, {S.milli(_FOOT[1])} AS y_milli FROM trk")
def tactical_points(spark, d):
    return tactical.feet(T.tracks(spark, d), HL).select("frame_idx", "is_referee", "track_id", milli(F.col("x")).alias("x_milli"), milli(F.col("y")).alias("y_milli"))


@query(f"SELECT frame_idx, is_referee, track_id, {FIVE} AS n_inside FROM trk")
def court_overlap5(spark, d):
    return tactical.court_points(T.tracks(spark, d), HL).select("frame_idx", "is_referee", "track_id", F.col("n_inside").cast("long").alias("n_inside"))


#: A player's own mask, cut to its box grown by 20 %, where that leaves 80 pixels and 35 % of it; and every (n // 2500)-th of its pixels on the court.
_OWN_MASK = f"""{OWNERS}, wide AS (SELECT t.game_id, t.frame_idx, t.track_id, ow.mask_id, greatest(0, CAST(round_even(x1 - greatest(1, x2 - x1) * 0.20::double, 0) AS BIGINT)) AS wx1,
  greatest(0, CAST(round_even(y1 - greatest(1, y2 - y1) * 0.20::double, 0) AS BIGINT)) AS wy1, least(1280, CAST(round_even(x2 + greatest(1, x2 - x1) * 0.20::double, 0) AS BIGINT)) AS wx2,
  least(720, CAST(round_even(y2 + greatest(1, y2 - y1) * 0.20::double, 0) AS BIGINT)) AS wy2 FROM crw t JOIN ow USING (game_id, frame_idx, track_id) WHERE NOT t.is_referee),
cut AS (SELECT w.*, m.y, greatest(x_start, wx1) AS x_start, least(x_end, wx2) AS x_end FROM wide w JOIN mr m ON m.frame_idx = w.frame_idx AND m.mask_id = w.mask_id AND y >= wy1 AND y < wy2 AND x_end > wx1 AND x_start < wx2),
ms AS (SELECT game_id, frame_idx, track_id, mask_id, any_value(total) AS total, sum(x_end - x_start) AS wide FROM cut JOIN (SELECT frame_idx, mask_id, sum(x_end - x_start) AS total FROM mr GROUP BY ALL) USING (frame_idx, mask_id) GROUP BY ALL),
okm AS (SELECT * FROM ms WHERE wide >= 80 AND CAST(wide AS DOUBLE) / total >= 0.35)"""
_PIX_H = S.inside(S.project("x", "y", HL))
_ON_COURT = f"""px AS (SELECT c.frame_idx, c.track_id, c.y, unnest(range(c.x_start, c.x_end)) AS x FROM cut c JOIN okm USING (frame_idx, track_id)),
nb AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY frame_idx, track_id) AS area FROM px),
oc AS (SELECT frame_idx, track_id, count(*) AS n_sampled, count(*) FILTER ({_PIX_H}) AS n_on, any_value(area) AS area FROM nb WHERE k % greatest(1, area // 2500) = 0 GROUP BY ALL)"""


def own_masks(spark, d):
    return masks.track_masks(T.crowd(spark, d), owners(spark, d), T.mask_runs(spark, d))


@query(f"{_OWN_MASK} SELECT frame_idx, track_id, mask_id, CAST(wide AS BIGINT) AS wide FROM okm")
def mask_lookup(spark, d):
    return own_masks(spark, d).groupBy("frame_idx", "track_id", "mask_id").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("wide"))


@query(f"{_OWN_MASK}, {_ON_COURT} SELECT frame_idx, track_id, n_sampled, n_on, CAST(round_even(area * (CAST(n_on AS DOUBLE) / n_sampled), 0) AS BIGINT) AS inside_area FROM oc")
def mask_court_overlap(spark, d):
    return masks.court_overlap(own_masks(spark, d), HL, "track_id").select("frame_idx", "track_id", "n_sampled", "n_on", "inside_area")


#: Frames 3 to 9 of ten have a stale homography. A player without a mask on the court is put off in these; otherwise its mask (12 % on the court) or two
#: of five points of its box make it active for good.
@query(f"""
{_OWN_MASK}, {_ON_COURT},
hit AS (SELECT c.game_id, c.frame_idx, c.is_referee, c.track_id, NOT (coalesce(n_on, 0) = 0 AND c.frame_idx % 10 >= 3) AND (coalesce(CAST(n_on AS DOUBLE) / n_sampled >= 0.12, false) OR {FIVE} >= 2) AS hit
  FROM crw c LEFT JOIN oc ON oc.frame_idx = c.frame_idx AND oc.track_id = c.track_id AND NOT c.is_referee)
SELECT frame_idx, is_referee, track_id, is_referee OR bool_or(hit) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS active FROM hit
""")
def court_active(spark, d):
    t = T.crowd(spark, d)
    stale = t.select("game_id", "frame_idx").distinct().where("frame_idx % 10 >= 3")
    return tactical.activated(tactical.court_points(t, HL), masks.court_overlap(own_masks(spark, d), HL, "track_id"), stale).select("frame_idx", "is_referee", "track_id", "active")


@query(f"""
{S.MATCHED},
b AS (SELECT p.vec_id AS point_id, mt.*, sqrt((p.x - mt.x) * (p.x - mt.x) + (p.y - mt.y) * (p.y - mt.y)) AS d FROM (SELECT vec_id, (vec_id * 7) % 1280 AS x, (vec_id * 11) % 720 AS y FROM embeddings) p JOIN mt ON mt.frame_idx = p.vec_id),
n AS (SELECT *, power(d + 1, -1.35::double) * least(greatest(conf, 0.25::double), 1.0::double) AS w FROM b QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, kp_idx) <= 6)
SELECT point_id, count(*) AS n, {S.milli('least(greatest(sum(w * tx) / sum(w), 0), 299)')} AS tx_milli, {S.milli('least(greatest(sum(w * ty) / sum(w), 0), 160)')} AS ty_milli FROM n GROUP BY 1 HAVING count(*) >= 2
""")
def idw_project(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(T.game_of(F.col("vec_id")), F.col("vec_id").alias("frame_idx"), F.col("vec_id").alias("point_id"), ((F.col("vec_id") * 7) % 1280).alias("x"), ((F.col("vec_id") * 11) % 720).alias("y"))
    return court.weighted_projection(v, matched(spark, d)).select("point_id", "n", milli(F.col("tx")).alias("tx_milli"), milli(F.col("ty")).alias("ty_milli"))


@query(f"{S.GOOD}, {S.LAYOUT} SELECT frame_idx, n_pairs, {S.milli('slope')} AS slope_milli, side FROM ly")
def layout_side(spark, d):
    return court.layout_side(good_views(spark, d)).select("frame_idx", "n_pairs", milli(F.col("slope")).alias("slope_milli"), "side")


_FLAT = """fv AS (SELECT game_id, frame_idx, kp_idx, conf, CASE WHEN frame_idx % 90 < 45 THEN x - (CASE (frame_idx // 60) % 2 WHEN 0 THEN -1 ELSE 1 END) * (ty - 80) ELSE x END AS x,
  CASE WHEN kp_idx IN (15, 16, 17) AND frame_idx % 30 >= 20 OR frame_idx < 10 AND kp_idx >= 9 THEN NULL ELSE y END AS y FROM vw JOIN tpl USING (kp_idx)),
gv AS (SELECT game_id, frame_idx, kp_idx, conf, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT *, x >= 10 AND x < 1270 AND y >= 10 AND y < 710 AS ok FROM fv))"""


def flat_views(spark, d):
    """The views with upright lines in half of the frames, so that the layout says nothing there, and without the centre line in some."""
    v = T.views(spark, d).join(F.broadcast(T.template(spark).select("kp_idx", "ty")), "kp_idx")
    side = F.when(F.floor(F.col("frame_idx") / 60) % 2 == 0, -1).otherwise(1)
    x = F.when(F.col("frame_idx") % 90 < 45, F.col("x") - side * (F.col("ty") - 80)).otherwise(F.col("x"))
    gone = F.col("kp_idx").isin(15, 16, 17) & (F.col("frame_idx") % 30 >= 20) | (F.col("frame_idx") < 10) & (F.col("kp_idx") >= 9)
    return keypoints.inside_border(v.withColumn("x", x).withColumn("y", F.when(~gone, F.col("y"))).drop("ty"))


#: The observed side: the layout's; else by the mean x of the centre line's points in the frame (below 0.4 of the width: right, above 0.6: left); else by where the
#: centre line was when it was last looked at; else by counts of 3 or more with a margin of 2.
_SIDES = f"""{_FLAT}, {S.LAYOUT},
cnt AS (SELECT game_id, frame_idx, count(*) FILTER (g AND (kp_idx BETWEEN 0 AND 5 OR kp_idx IN (9, 11))) AS n_left, count(*) FILTER (g AND kp_idx BETWEEN 15 AND 17) AS n_center,
  count(*) FILTER (g AND (kp_idx BETWEEN 27 AND 32 OR kp_idx IN (21, 23))) AS n_right, avg(x) FILTER (g AND kp_idx BETWEEN 15 AND 17) AS center_x FROM (SELECT *, coalesce(x > 0 AND y > 0, false) AND conf >= 0.05 AS g FROM gv) GROUP BY ALL),
ca AS (SELECT cnt.*, ly.side AS layout, last_value(CASE WHEN ly.side IS NULL THEN center_x END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY frame_idx) AS last_center FROM cnt LEFT JOIN ly USING (frame_idx)),
sd AS (SELECT *, CASE WHEN layout IS NOT NULL THEN layout WHEN center_x IS NOT NULL THEN CASE WHEN center_x / 1280 < 0.4 THEN 'right' WHEN center_x / 1280 > 0.6 THEN 'left' ELSE 'center' END
  WHEN last_center IS NOT NULL THEN CASE WHEN last_center / 1280 < 0.5 THEN 'right' ELSE 'left' END WHEN n_right >= 3 AND n_right >= n_left + 2 THEN 'right' WHEN n_left >= 3 AND n_left >= n_right + 2 THEN 'left' END AS side FROM ca)"""


@query(f"{_SIDES} SELECT frame_idx, n_left, n_center, n_right, layout, {S.milli('center_x')} AS center_milli, side FROM sd")
def side_counts(spark, d):
    return court.observed_side(flat_views(spark, d)).select("frame_idx", "n_left", "n_center", "n_right", "layout", milli(F.col("center_x")).alias("center_milli"), "side")


@query(f"{_SIDES} SELECT frame_idx, {S.milli('last_center')} AS center_milli FROM sd")
def center_carry(spark, d):
    return court.observed_side(flat_views(spark, d)).select("frame_idx", milli(F.col("last_center")).alias("center_milli"))


_ERR = f"sqrt(power({_X} - tx, 2) + power({_Y} - ty, 2))"


@query(f"{S.MATCHED} SELECT frame_idx, count(*) AS n, {S.milli(f'CASE WHEN count(*) >= 4 THEN median({_ERR}) END')} AS err_milli FROM mt GROUP BY 1")
def reprojection_error(spark, d):
    return court.reprojection(matched(spark, d), HL).select("frame_idx", "n", milli(F.col("median_err")).alias("err_milli"))


@query(f"{S.MATCHED} SELECT frame_idx, kp_idx FROM mt WHERE {_ERR} <= 50")
def reprojection_inliers(spark, d):
    return court.without_outliers(matched(spark, d), HL, CFG.outlier_px).select("frame_idx", _point())


#: The frame's corners, the middles of its edges, and its centre.
_NINE = [(f"{x}::double", f"{y}::double") for y in (0.0, 360.0, 719.0) for x in (0.0, 640.0, 1279.0)]
_SHIFT = ["sqrt(power({} - {}, 2) + power({} - {}, 2))".format(a[0], b[0], a[1], b[1]) for a, b in ((S.project(x, y, HL), S.project(x, y, court.OTHER_H)) for x, y in _NINE)]


@query(f"SELECT DISTINCT frame_idx, {S.milli('(' + ' + '.join(_SHIFT) + ') / 9')} AS mean_milli, {S.milli('greatest(' + ', '.join(_SHIFT) + ')')} AS max_milli FROM kp")
def h_shift(spark, d):
    frames = T.keypoints(spark, d).select("frame_idx").distinct()
    return court.homography_shift(frames, HL, court.OTHER_H).select("frame_idx", milli(F.col("mean_shift")).alias("mean_milli"), milli(F.col("max_shift")).alias("max_milli"))


_PRIOR = f"""{S.GOOD}, gd AS (SELECT * FROM gv WHERE x > 0 AND y > 0 AND conf >= 0.1),
fr AS (SELECT game_id, frame_idx, lag(frame_idx) OVER (PARTITION BY game_id ORDER BY frame_idx) AS b FROM (SELECT DISTINCT game_id, frame_idx FROM gv)),
dx AS (SELECT f.game_id, f.frame_idx, f.b, CAST(a.x - o.x AS DOUBLE) AS dx FROM fr f JOIN gd a ON a.frame_idx = f.frame_idx JOIN gd o ON o.frame_idx = f.b AND o.kp_idx = a.kp_idx),
md AS (SELECT frame_idx, median(dx) AS med FROM dx GROUP BY 1),
ag AS (SELECT dx.frame_idx, any_value(med) AS med, count(*) AS n, median(abs(dx - med)) AS mad, avg(CAST(sign(dx) = CASE WHEN med > 0 THEN 1 ELSE -1 END AS DOUBLE)) AS agree FROM dx JOIN md USING (frame_idx) GROUP BY 1),
cf AS (SELECT f.game_id, f.frame_idx, f.b, med, coalesce(n, 0) AS n, mad, CASE WHEN n >= 4 AND abs(med) >= 2 THEN agree * greatest(0, 1 - mad / 18.0::double) ELSE 0 END AS conf FROM fr f LEFT JOIN ag USING (frame_idx)),
pp AS (SELECT *, CASE WHEN n >= 4 AND abs(med) >= 2 AND mad <= 18 AND conf >= 0.35 THEN -(med / greatest(1, frame_idx - b)) * (300.0::double / 1280) ELSE 0 END AS dx FROM cf)"""


@query(f"{_PRIOR} SELECT frame_idx, n, {S.milli('med')} AS med_milli, {S.milli('mad')} AS mad_milli, {S.milli('conf')} AS conf_milli, {S.milli('dx')} AS dx_milli FROM pp")
def pan_prior(spark, d):
    return court.pan_prior(good_views(spark, d)).select("frame_idx", "n", *(milli(F.col(c)).alias(f"{c}_milli") for c in ("med", "mad", "conf", "dx")))


_PAN = f"""{_PRIOR}, pn AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY frame_idx) AS n_ FROM pp),
ps(game_id, n_, frame_idx, d, c) AS (SELECT game_id, n_, frame_idx, CASE WHEN conf >= 0.35 THEN dx ELSE 0::double END, CASE WHEN conf >= 0.35 THEN conf ELSE 0::double END FROM pn WHERE n_ = 1 UNION ALL
  SELECT p.game_id, p.n_, p.frame_idx, CASE WHEN p.conf >= 0.35 THEN CASE WHEN s.c >= 0.35 THEN s.d * 0.55::double + p.dx * (1 - 0.55::double) ELSE p.dx END WHEN abs(s.d * 0.75::double) < 0.05 THEN 0::double ELSE s.d * 0.75::double END,
  CASE WHEN p.conf >= 0.35 THEN p.conf WHEN abs(s.d * 0.75::double) < 0.05 THEN 0::double ELSE s.c * 0.75::double END FROM ps s JOIN pn p ON p.game_id = s.game_id AND p.n_ = s.n_ + 1)"""


@query(f"{_PAN} SELECT frame_idx, {S.milli('d')} AS dx_milli, {S.milli('c')} AS conf_milli FROM ps")
def pan_state(spark, d):
    return keypoints.pan_state(court.pan_prior(good_views(spark, d))).select("frame_idx", milli(F.col("pan_dx")).alias("dx_milli"), milli(F.col("pan_conf")).alias("conf_milli"))


@query("SELECT frame_idx, kp_idx % 2 AS instance, kp_idx // 2 AS kp_idx, CASE WHEN x <> 0 OR y <> 0 THEN CAST(x AS DOUBLE) END AS x, conf FROM kp")
def nested_keypoints(spark, d):
    """Results whose predictions and keypoints are held in another way from frame to frame."""
    k, f = T.keypoints(spark, d), F.col("frame_idx")
    point = F.struct(F.floor(F.col("kp_idx") / 2).cast("int").alias("class_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "conf")
    held = lambda name, text: F.concat(F.lit(f'{{"{name}":'), text, F.lit("}"))
    one_of = lambda n, *forms: F.element_at(F.array(*forms), (f % n).cast("int") + 1)
    per = k.groupBy("game_id", "frame_idx", (F.col("kp_idx") % 2).alias("i")).agg(F.array_sort(F.collect_list(point)).alias("ps"))
    ps = F.to_json("ps")
    values = F.to_json(F.map_from_arrays(F.transform("ps", lambda p: F.concat(F.lit("p"), p["class_id"])), "ps"))
    per = per.select("game_id", "frame_idx", "i", held("keypoints", one_of(5, ps, held("items", ps), held("predictions", ps), held("keypoints", ps), values)).alias("p"))
    both = per.groupBy("game_id", "frame_idx").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda v: v["p"]), ","), F.lit("]")).alias("ps"))
    result = held("predictions", one_of(3, F.col("ps"), held("items", F.col("ps")), held("predictions", F.col("ps"))))
    raw = both.select("game_id", "frame_idx", one_of(2, result, F.concat(F.lit("["), result, F.lit(",{}]"))).alias("json"))
    return scans.nested_keypoints(raw).select("frame_idx", F.col("instance").cast("long").alias("instance"), _point(), "x", "conf")


@query("""
i AS (SELECT frame_idx, kp_idx % 2 AS instance, count(*) AS n, count(*) FILTER (x > 0 AND y > 0 AND conf >= 0.1) + 0.01::double * sum(conf) AS score FROM kp GROUP BY ALL)
SELECT frame_idx, instance, n FROM i QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY round(score, 6) DESC, instance) = 1
""")
def kp_best_instance(spark, d):
    return keypoints.best_instance(T.keypoints(spark, d).withColumn("instance", (F.col("kp_idx") % 2).cast("long"))).select("frame_idx", "instance", "n")


@query("""
i AS (SELECT frame_idx, kp_idx % 3 AS instance, count(*) AS n, count(*) FILTER (conf >= 0.1) AS score FROM kp GROUP BY ALL)
SELECT frame_idx, instance, n FROM i QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY score DESC, instance) = 1
""")
def kp_best_columnar(spark, d):
    return keypoints.best_instance(T.keypoints(spark, d).withColumn("instance", (F.col("kp_idx") % 3).cast("long")), by_confidence=True).select("frame_idx", "instance", "n")


#: Names, class ids, keypoint ids and positions by turns there, bad or missing.
@query("""
f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'kp ' || event_id % 45 WHEN 2 THEN 'corner' WHEN 3 THEN CAST(event_id % 45 AS VARCHAR) END AS name, CASE WHEN event_id % 7 = 0 THEN '2' || event_id % 3 END AS alias,
  CASE event_id % 3 WHEN 0 THEN CAST(event_id % 40 AS VARCHAR) WHEN 1 THEN 'x' END AS class_id, event_id % 36 AS keypoint_id, event_id % 50 AS position, CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN '0.5' END AS conf FROM events),
g AS (SELECT *, coalesce(nullif(regexp_replace(name, '[^0-9]', '', 'g'), ''), nullif(regexp_replace(alias, '[^0-9]', '', 'g'), '')) AS digits, coalesce(TRY_CAST(coalesce(class_id, CAST(keypoint_id AS VARCHAR)) AS BIGINT), position) AS raw FROM f),
h AS (SELECT *, CASE WHEN length(digits) < 2 THEN lpad(digits, 2, '0') ELSE digits END AS label FROM g)
SELECT event_id, h.label, raw, coalesce(t.kp_idx, r.kp_idx, -1) AS idx, CASE WHEN t.kp_idx IS NOT NULL THEN t.legacy_idx ELSE coalesce(r.legacy_idx, -1) END AS old_idx, CASE WHEN conf IS NULL THEN 1 ELSE coalesce(TRY_CAST(conf AS DOUBLE), 0) END::double AS conf
FROM h LEFT JOIN tpl t ON t.label = h.label LEFT JOIN tpl r ON r.kp_idx = h.raw
""")
def keypoint_labels(spark, d):
    e, none = F.col("event_id"), F.lit(None).cast("string")
    name = F.when(e % 4 == 0, F.concat(F.lit("kp "), (e % 45).cast("string"))).when(e % 4 == 2, "corner").when(e % 4 == 3, (e % 45).cast("string"))
    alias = F.when(e % 7 == 0, F.concat(F.lit("2"), (e % 3).cast("string")))
    label = X.keypoint_label(name, alias)
    raw = X.raw_index(F.when(e % 3 == 0, (e % 40).cast("string")).when(e % 3 == 1, "x"), none, (e % 36).cast("string"), e % 50)
    conf = X.confidence_of(F.when(e % 5 == 0, "bad").when(e % 5 == 1, "0.5"), none)
    rows = T.events(spark, d).select("event_id", label.alias("label"), raw.alias("raw"), conf.alias("conf"))
    return rows.select("event_id", "label", "raw", X.keypoint_index(F.col("label"), F.col("raw")).alias("idx"), X.old_index(F.col("label"), F.col("raw")).alias("old_idx"), "conf")


@query("SELECT v.frame_idx, v.kp_idx, coalesce(t.legacy_idx, -1) AS legacy_idx FROM vw v JOIN tpl l ON l.kp_idx = v.kp_idx LEFT JOIN tpl t ON t.label = l.label AND t.kp_idx % 4 <> 3")
def legacy_index(spark, d):
    k = T.views(spark, d).join(F.broadcast(T.template(spark).select("kp_idx", "label")), "kp_idx")
    return court.legacy_index(k, T.template(spark).where("kp_idx % 4 <> 3").select("label", "legacy_idx")).select("frame_idx", _point(), "legacy_idx")


#: Valid points have both coordinates above 0; the border is 10 pixels, the edge band 30 % of each side.
@query("""
SELECT frame_idx, count(*) FILTER (x > 0 AND y > 0) AS n_valid, count(*) FILTER (conf >= 0.1) AS n_low, count(*) FILTER (conf >= 0.5) AS n_high, count(*) FILTER (x >= 10 AND x < 1270 AND y >= 10 AND y < 710) AS n_inside,
  count(*) FILTER (x > 0 AND y > 0 AND (x <= 384 OR x >= 896 OR y <= 216 OR y >= 504)) AS n_band FROM vw GROUP BY 1
""")
def kp_validity(spark, d):
    return keypoints.validity(T.views(spark, d)).drop("game_id")


#: Updates in a row in which a point is in the edge band and within 6 pixels of where it was the update before; 45 of them drop it.
@query(f"""
{S.GOOD}, h AS (SELECT *, coalesce((x <= 384 OR x >= 896 OR y <= 216 OR y >= 504) AND sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) <= 6, false) AS hangs FROM gv WINDOW w AS (PARTITION BY game_id, kp_idx ORDER BY frame_idx)),
r AS (SELECT *, sum(CASE WHEN hangs THEN 0 ELSE 1 END) OVER (PARTITION BY game_id, kp_idx ORDER BY frame_idx) AS run FROM h)
SELECT frame_idx, kp_idx, CAST(sum(CASE WHEN hangs THEN 1 ELSE 0 END) OVER w AS BIGINT) AS still, sum(CASE WHEN hangs THEN 1 ELSE 0 END) OVER w >= 45 AS dropped FROM r WINDOW w AS (PARTITION BY game_id, kp_idx, run ORDER BY frame_idx)
""")
def kp_still(spark, d):
    return keypoints.still_runs(good_views(spark, d)).select("frame_idx", _point(), F.col("still").cast("long").alias("still"), "dropped")


_RN = f"{S.GOOD}, rn AS (SELECT *, row_number() OVER (PARTITION BY game_id, kp_idx ORDER BY frame_idx) AS n FROM gv)"


@query(f"""
{_RN}, c AS (SELECT frame_idx, kp_idx, n - last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER w AS age, last_value(x IGNORE NULLS) OVER w AS gx, last_value(y IGNORE NULLS) OVER w AS gy
  FROM rn WINDOW w AS (PARTITION BY game_id, kp_idx ORDER BY frame_idx))
SELECT frame_idx, kp_idx, CASE WHEN age <= 45 THEN gx END AS x, CASE WHEN age <= 45 THEN gy END AS y, age FROM c
""")
def kp_carry(spark, d):
    return keypoints.carried(good_views(spark, d)).select("frame_idx", _point(), "x", "y", F.col("age").cast("long").alias("age"))


_EMA_KP = f"""{_RN}, sm(game_id, kp_idx, n, frame_idx, x, y, missing) AS (SELECT game_id, kp_idx, n, frame_idx, CAST(x AS DOUBLE), CAST(y AS DOUBLE), CASE WHEN x IS NULL THEN 1 ELSE 0 END FROM rn WHERE n = 1 UNION ALL
SELECT s.game_id, s.kp_idx, s.n, s.frame_idx, CASE WHEN s.x IS NULL THEN CASE WHEN r.missing + 1 <= 45 THEN r.x END WHEN r.x IS NULL THEN s.x ELSE s.x * 0.6::double + r.x * 0.4::double END,
CASE WHEN s.x IS NULL THEN CASE WHEN r.missing + 1 <= 45 THEN r.y END WHEN r.y IS NULL THEN s.y ELSE s.y * 0.6::double + r.y * 0.4::double END, CASE WHEN s.x IS NULL THEN r.missing + 1 ELSE 0 END
FROM sm r JOIN rn s ON s.game_id = r.game_id AND s.kp_idx = r.kp_idx AND s.n = r.n + 1)"""


@query(f"{_EMA_KP} SELECT frame_idx, kp_idx, {S.milli('x')} AS x_milli, {S.milli('y')} AS y_milli, CAST(missing AS BIGINT) AS missing FROM sm")
def kp_smooth(spark, d):
    out = keypoints.smoothed(good_views(spark, d))
    return out.select("frame_idx", _point(), milli(F.col("x")).alias("x_milli"), milli(F.col("y")).alias("y_milli"), F.col("missing").cast("long").alias("missing"))


@query(f"""
{_EMA_KP}, j AS (SELECT a.frame_idx, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) > 150 AS far FROM rn a JOIN sm b ON b.game_id = a.game_id AND b.kp_idx = a.kp_idx AND b.n + 1 = a.n
  WHERE a.x IS NOT NULL AND b.x >= 10 AND b.x < 1270 AND b.y >= 10 AND b.y < 710)
SELECT frame_idx, count(*) AS n_matched, count(*) FILTER (far) AS n_moved, count(*) FILTER (far) > 0.5 * count(*) AS reset FROM j GROUP BY 1
""")
def kp_jump_reset(spark, d):
    k = good_views(spark, d)
    return keypoints.jump_resets(k, keypoints.smoothed(k)).drop("game_id")


@query("""
u AS (SELECT frame_idx AS update_frame, count(*) FILTER (conf >= 0.5) AS n_high FROM vw WHERE frame_idx % 2 = 0 GROUP BY 1)
SELECT f.frame_idx, f.frame_idx - f.frame_idx % 2 AS update_frame, n_high FROM (SELECT DISTINCT frame_idx FROM vw) f JOIN u ON u.update_frame = f.frame_idx - f.frame_idx % 2
""")
def kp_hold(spark, d):
    k = T.views(spark, d)
    updates = k.where(F.col("frame_idx") % 2 == 0).groupBy("game_id", "frame_idx").agg(F.count_if(F.col("conf") >= 0.5).alias("n_high"))
    return keypoints.hold(k.select("game_id", "frame_idx").distinct(), updates).select("frame_idx", "update_frame", "n_high")


#: Observed sides and accepted homographies by formula. An accepted one sets the side at once; otherwise 6 updates in a row that show another side turn it, and a turn
#: begins a transition of 8 updates, each of which ends by counting it down.
@query("""
fr AS (SELECT DISTINCT game_id, frame_idx FROM kp),
o AS (SELECT *, CASE (frame_idx // 9 + frame_idx // 14) % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN CASE WHEN frame_idx % 5 < 4 THEN 'left' ELSE 'center' END END AS side, frame_idx % 50 BETWEEN 5 AND 7 AS acc,
  row_number() OVER (PARTITION BY game_id ORDER BY frame_idx) AS n FROM fr),
st(game_id, n, frame_idx, state, pending, streak, transition, reseed, switched) AS (SELECT game_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 0, false, false FROM o WHERE n = 1 UNION ALL
  SELECT game_id, n, frame_idx, CASE WHEN turn OR (acc AND side IN ('left', 'right')) THEN side ELSE state END, CASE WHEN ends OR turn THEN NULL ELSE side END, CASE WHEN turn THEN 0 ELSE count END,
    greatest(0, CASE WHEN turn THEN 8 ELSE transition END - 1), NOT acc AND (turn OR reseed), turn
  FROM (SELECT *, state IS NOT NULL AND count >= 6 AS turn FROM (SELECT *, CASE WHEN ends THEN 0 WHEN side = pending THEN streak + 1 ELSE 1 END AS count FROM (
    SELECT o.game_id, o.n, o.frame_idx, o.side, o.acc, s.state, s.pending, s.streak, s.transition, s.reseed, o.side IS NULL OR o.side = 'center' OR coalesce(o.side = s.state, false) AS ends FROM st s JOIN o ON o.game_id = s.game_id AND o.n = s.n + 1))))
SELECT frame_idx, state, CAST(streak AS BIGINT) AS streak, CAST(transition AS BIGINT) AS transition, reseed, switched FROM st WHERE n > 0
""")
def side_hysteresis(spark, d):
    f = F.col("frame_idx")
    turn = (F.floor(f / 9) + F.floor(f / 14)) % 4
    side = F.when(turn == 0, "left").when(turn == 1, "right").when(turn == 2, F.when(f % 5 < 4, "left").otherwise("center"))
    rows = T.keypoints(spark, d).select("game_id", "frame_idx").distinct().select("game_id", "frame_idx", side.alias("side"), (f % 50).between(5, 7).alias("accepted"))
    out = keypoints.side_state(rows)
    return out.select("frame_idx", "state", F.col("streak").cast("long").alias("streak"), F.col("transition").cast("long").alias("transition"), "reseed", "switched")


@query(f"""
{S.MATCHED}, m AS (SELECT frame_idx, avg(tx) AS mean FROM mt WHERE x > 0 AND y > 0 GROUP BY 1),
w AS (SELECT *, CASE frame_idx % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' END AS want, CASE WHEN mean < 129 THEN 'left' WHEN mean > 171 THEN 'right' ELSE 'center' END AS ns,
  CASE WHEN 300 - mean < 129 THEN 'left' WHEN 300 - mean > 171 THEN 'right' ELSE 'center' END AS ms FROM m)
SELECT frame_idx, CASE WHEN want IN ('left', 'right') AND ns = want THEN 'normal' WHEN want IN ('left', 'right') AND ms = want THEN 'mirrored' WHEN frame_idx % 3 = 0 THEN 'mirrored' ELSE 'normal' END AS mode FROM w
""")
def template_mode(spark, d):
    m = matched(spark, d).where(court.seen()).groupBy("frame_idx").agg(F.avg(F.col("tx").cast("double")).alias("mean"))
    side = F.when(F.col("frame_idx") % 4 == 0, "left").when(F.col("frame_idx") % 4 == 1, "right").when(F.col("frame_idx") % 4 == 2, "center")
    return m.select("frame_idx", court.template_mode(side, F.lit(None).cast("string"), F.col("mean"), F.when(F.col("frame_idx") % 3 == 0, "mirrored")).alias("mode"))


_H = [f"(({v!r})::double * (1 + event_id % 3))" for v in HL]
_DET = f"({_H[0]} * ({_H[4]} * {_H[8]} - {_H[5]} * {_H[7]}) - {_H[1]} * ({_H[3]} * {_H[8]} - {_H[5]} * {_H[6]}) + {_H[2]} * ({_H[3]} * {_H[7]} - {_H[4]} * {_H[6]}))"


@query(f"SELECT event_id, event_id % 7 >= 4 AND abs({_DET}) >= 1e-8 AND value <= 60 AS ok FROM events WHERE value IS NOT NULL")
def homography_gate(spark, d):
    h = [F.lit(float(v)) * (1 + F.col("event_id") % 3) for v in HL]
    ok = G.valid_homography(F.col("event_id") % 7, h, F.col("value"), CFG)
    return T.events(spark, d).where("value IS NOT NULL").select("event_id", ok.alias("ok"))


@query()
def homography_estimates(spark, d):
    out = homography.estimates(matched(spark, d))
    return out.select("frame_idx", "mode", "n", "ok", F.round("residual", 3).alias("residual"))


_STAYS = """ft AS (SELECT game_id, frame_idx, is_referee, track_id, (x1 + x2) / 2.0::double AS x, CAST(greatest(y1, y2 - 3) AS DOUBLE) AS y FROM trk),
sg AS (SELECT *, coalesce(CAST(frame_idx - lag(frame_idx) OVER w > 12 AS INTEGER), 0) AS f FROM ft WINDOW w AS (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx)),
st AS (SELECT *, sum(f) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS stay FROM sg),
nn AS (SELECT *, row_number() OVER (PARTITION BY game_id, is_referee, track_id, stay ORDER BY frame_idx) AS n FROM st)"""
_FAR = "sqrt(power(n.x - e.sx, 2) + power(n.y - e.sy, 2))"
_STEP = f"(CASE WHEN {_FAR} > 18 THEN 18.0::double / greatest({_FAR}, 1e-6::double) ELSE 1.0::double END)"
EMA = f"""{_STAYS}, ema(game_id, is_referee, track_id, stay, n, frame_idx, sx, sy) AS (SELECT game_id, is_referee, track_id, stay, n, frame_idx, x, y FROM nn WHERE n = 1 UNION ALL
SELECT n.game_id, n.is_referee, n.track_id, n.stay, n.n, n.frame_idx, e.sx * 0.45::double + (e.sx + (n.x - e.sx) * {_STEP}) * 0.55::double, e.sy * 0.45::double + (e.sy + (n.y - e.sy) * {_STEP}) * 0.55::double
FROM ema e JOIN nn n ON n.game_id = e.game_id AND n.is_referee = e.is_referee AND n.track_id = e.track_id AND n.stay = e.stay AND n.n = e.n + 1)"""


#: A pan is in force while it is sure and its last sure update no more than 6 frames old; then a target against it counts for 0.15, and another is drawn to it.
_FORCE = f"""{_PAN},
pq AS (SELECT ps.*, max(ps.frame_idx) FILTER (pn.conf >= 0.35) OVER (PARTITION BY ps.game_id ORDER BY ps.frame_idx) AS sf FROM ps JOIN pn USING (game_id, frame_idx)),
pf AS (SELECT f.game_id, f.frame_idx, CASE WHEN q.c >= 0.35 AND f.frame_idx - q.sf <= 6 THEN q.d ELSE 0::double END AS pd, CASE WHEN q.c >= 0.35 AND f.frame_idx - q.sf <= 6 THEN q.c ELSE 0::double END AS pc
  FROM (SELECT DISTINCT game_id, frame_idx FROM trk) f ASOF LEFT JOIN pq q ON q.game_id = f.game_id AND q.frame_idx <= f.frame_idx)"""
_CLIP = "greatest(0::double, least({}, 299.0::double))".format
_PANNED = f"""CASE WHEN abs(n.pd) < 0.1 THEN n.x WHEN abs(n.x - e.sx) >= 0.5 AND (n.x - e.sx) * n.pd < 0 THEN {_CLIP('e.sx + (n.x - e.sx) * 0.15::double + n.pd * (1 - 0.15::double)')}
  ELSE {_CLIP(f"n.x * (1 - n.pc * 0.30::double) + {_CLIP('e.sx + n.pd')} * (n.pc * 0.30::double)")} END"""


@query(f"""
{_STAYS}, {_FORCE}, np AS (SELECT nn.* REPLACE (x / 4.0::double AS x), coalesce(pd, 0) AS pd, coalesce(pc, 0) AS pc FROM nn LEFT JOIN pf USING (game_id, frame_idx)),
emp(game_id, is_referee, track_id, stay, n, frame_idx, sx, sy) AS (SELECT game_id, is_referee, track_id, stay, n, frame_idx, x, y FROM np WHERE n = 1 UNION ALL
SELECT game_id, is_referee, track_id, stay, n, frame_idx, sx * 0.45::double + (sx + (px - sx) * k) * 0.55::double, sy * 0.45::double + (sy + (y - sy) * k) * 0.55::double
FROM (SELECT *, CASE WHEN sqrt(power(px - sx, 2) + power(y - sy, 2)) > 18 THEN 18.0::double / greatest(sqrt(power(px - sx, 2) + power(y - sy, 2)), 1e-6::double) ELSE 1.0::double END AS k
  FROM (SELECT n.game_id, n.is_referee, n.track_id, n.stay, n.n, n.frame_idx, e.sx, e.sy, n.y, {_PANNED} AS px
    FROM emp e JOIN np n ON n.game_id = e.game_id AND n.is_referee = e.is_referee AND n.track_id = e.track_id AND n.stay = e.stay AND n.n = e.n + 1)))
SELECT frame_idx, is_referee, track_id, {S.milli('sx')} AS sx_milli, {S.milli('sy')} AS sy_milli FROM emp
""")
def ema_panned(spark, d):
    """Positions a quarter as wide as the image, so that many lie on the court, under a panning camera."""
    points = tactical.feet(T.tracks(spark, d)).withColumn("x", F.col("x") / 4.0)
    prior = court.pan_prior(good_views(spark, d))
    pans = tactical.pans_in_force(points, keypoints.pan_state(prior), prior)
    return tactical.smooth(points, CFG, pans).select("frame_idx", "is_referee", "track_id", milli(F.col("sx")).alias("sx_milli"), milli(F.col("sy")).alias("sy_milli"))


@query(f"{EMA} SELECT frame_idx, is_referee, track_id, {S.milli('sx')} AS sx_milli, {S.milli('sy')} AS sy_milli FROM ema")
def ema_tactical(spark, d):
    return tactical.smooth(tactical.feet(T.tracks(spark, d))).select("frame_idx", "is_referee", "track_id", milli(F.col("sx")).alias("sx_milli"), milli(F.col("sy")).alias("sy_milli"))


@query(f"""
{EMA} SELECT frame_idx, is_referee, track_id, count(*) OVER w AS n, {S.milli('first_value(sx) OVER w')} AS tail_milli FROM ema
WINDOW w AS (PARTITION BY game_id, is_referee, track_id, stay ORDER BY frame_idx ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)
""")
def trail18(spark, d):
    out = tactical.trails(tactical.smooth(tactical.feet(T.tracks(spark, d))))
    return out.select("frame_idx", "is_referee", "track_id", F.size("trail").cast("long").alias("n"), milli(F.element_at("trail", 1)["sx"]).alias("tail_milli"))


@query(f"{_STAYS} SELECT is_referee, track_id, CAST(stay AS BIGINT) AS stay, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM st GROUP BY game_id, is_referee, track_id, stay")
def tactical_stays(spark, d):
    out = tactical.stays(tactical.feet(T.tracks(spark, d)))
    per = out.groupBy("game_id", "is_referee", "track_id", "stay").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n"))
    return per.select("is_referee", "track_id", "stay", "first_frame", "last_frame", "n")
