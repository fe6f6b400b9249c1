"""Queries of scans, boxes, suppression and per-frame joins, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackweave.config import DEFAULT as CFG
from trackweave.functions import geometry as G
from trackweave.functions.geometry import milli
from trackweave.operators import court, lifecycle, masks, matching, report, suppress, tactical
from trackweave.plans import sql as S
from trackweave.plans.registry import query
from trackweave.sources import scans
from trackweave.sources import tables as T


@query("""
SELECT frame_idx AS src_idx, (frame_idx - 24) // 2 AS frame_idx FROM (SELECT DISTINCT frame_idx FROM det)
WHERE frame_idx >= 24 AND (frame_idx - 24) % 2 = 0 AND (frame_idx - 24) // 2 < 300
""")
def frame_scan(spark, d):
    source = T.detections(spark, d).select(F.col("frame_idx").alias("src_idx")).distinct()
    return scans.frames(source, scans.seconds_to_frame(0.8, 30), 300, 2).select("src_idx", "frame_idx")


@query("SELECT det_id, x1, y1, x2, y2 FROM det WHERE det_id % 5 <> 4")
def box_decode(spark, d):
    t, kind = T.detections(spark, d), F.col("det_id") % 5
    corner = lambda c: F.when(kind < 2, F.col(c))
    middle = lambda a, b: F.when(kind.isin(2, 3), (F.col(a) + F.col(b)) / 2)
    side = lambda a, b: F.when(kind != 4, F.col(b) - F.col(a))
    raw = t.select("det_id", *(corner(c).alias(c) for c in ("x1", "y1", "x2", "y2")), middle("x1", "x2").alias("cx"), middle("y1", "y2").alias("cy"), side("x1", "x2").alias("w"), side("y1", "y2").alias("h"))
    return scans.decoded_boxes(raw).select("det_id", "x1", "y1", "x2", "y2")


@query("""
l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  [' || event_type || '] n' ELSE event_type || ' n' END AS line FROM events)
SELECT event_id, nullif(regexp_extract(line, '^\\s*\\[([A-Za-z:-]+)', 1), '') AS tag FROM l
WHERE (starts_with(ltrim(line), '[view') OR starts_with(line, '[click') OR starts_with(ltrim(line), '[click') OR starts_with(line, 'error')) AND NOT contains(line, 'ck] n')
""")
def log_lines(spark, d):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  ["), F.col("event_type"), F.lit("] n"))).otherwise(F.concat(F.col("event_type"), F.lit(" n")))
    rows = T.events(spark, d).select("event_id", line.alias("line"))
    shown = scans.without_noise(rows.where(scans.starts_with_any(F.col("line"), ("[view", "[click", "error"))), ("ck] n",))
    return scans.tagged_lines(shown).select("event_id", "tag")


@query(f"""
{S.TARGETS}
SELECT x.frame_idx, k.det_id AS a_id, x.det_id AS b_id, {S.milli(S.iou('k.', 'x.'))} AS iou_milli
FROM tg k JOIN tg x ON k.frame_idx = x.frame_idx AND k.det_id < x.det_id WHERE {S.ROLES}
""")
def det_iou_pairs(spark, d):
    return matching.iou_pairs(T.detections(spark, d)).select("frame_idx", F.col("a_det_id").alias("a_id"), F.col("b_det_id").alias("b_id"), milli(F.col("iou")).alias("iou_milli"))


@query(f"{S.NMS} SELECT frame_idx, det_id, is_referee, class_id, confidence FROM kept")
def det_nms(spark, d):
    return suppress.suppress_detections(T.detections(spark, d)).select("frame_idx", "det_id", "is_referee", "class_id", "confidence")


@query(f"""
{S.NMS}
SELECT x.frame_idx, x.det_id AS dropped_id, k.det_id AS kept_id FROM gone JOIN ord x ON x.g = gone.g AND x.n = gone.xn JOIN ord k ON k.g = gone.g AND k.n = gone.kn
""")
def det_ledger(spark, d):
    return suppress.suppression_ledger(T.detections(spark, d)).select("frame_idx", "dropped_id", "kept_id")


@query(f"{S.BYPASS} SELECT frame_idx, det_id, is_referee, confidence FROM kept")
def det_nms_bypass(spark, d):
    t = T.tracks(spark, d)
    return suppress.suppress_detections_by_track(T.detections(spark, d), t, lifecycle.births(t)).select("frame_idx", "det_id", "is_referee", "confidence")


@query(f"""
{S.BYPASS}
SELECT x.frame_idx, x.det_id, k.det_id AS by_det, x.top_track AS dropped_id, k.top_track AS kept_id
FROM gone JOIN ord x ON x.g = gone.g AND x.n = gone.xn JOIN ord k ON k.g = gone.g AND k.n = gone.kn
""")
def nms_ledger(spark, d):
    t = T.tracks(spark, d)
    return suppress.tracked_ledger(T.detections(spark, d), t, lifecycle.births(t)).select("frame_idx", "det_id", "by_det", "dropped_id", "kept_id")


_BORN = f"{S.births('crw')}, t AS (SELECT crw.*, birth_frame, birth_x, birth_y, frame_idx - birth_frame AS age FROM crw JOIN births USING (game_id, is_referee, track_id))"
_APART = "(k.track_id <> x.track_id AND (abs(k.birth_frame - x.birth_frame) > 3 OR sqrt(power(k.birth_x - x.birth_x, 2) + power(k.birth_y - x.birth_y, 2)) > 40))"
_TRACK_BARS = f"""CASE WHEN k.is_referee = x.is_referee THEN {S.iou('k.', 'x.')} >= 0.88 AND NOT (NOT ({S.YOUNG.format('k.age', 'x.age')} AND {S.iou('k.', 'x.')} >= 0.85) AND {_APART})
  ELSE {S.iou('k.', 'x.')} >= 0.80 END"""


@query(f"{_BORN}, {S.greedy('t', 'least(age, 60) DESC, confidence DESC, obs_id', _TRACK_BARS)} SELECT frame_idx, track_id, is_referee, confidence, age FROM kept")
def track_nms(spark, d):
    t = T.crowd(spark, d)
    return suppress.suppress_tracks(t, lifecycle.births(t)).select("frame_idx", "track_id", "is_referee", "confidence", "age")


_YOUNG_BARS = f"x.age <= 5 AND k.age >= 8 AND ({S.iou('k.', 'x.')} >= 0.85 OR ({S.iou('k.', 'x.')} >= 0.70 AND {S.dist('k.', 'x.')} <= 45))"


@query(f"{_BORN}, {S.greedy('t', 'least(age, 60) DESC, confidence DESC, track_id', _YOUNG_BARS, 'frame_idx * 2 + is_referee::int')} SELECT frame_idx, is_referee, track_id, confidence, age FROM kept")
def young_overlap_drop(spark, d):
    t = T.crowd(spark, d)
    return suppress.drop_young_overlaps(t, lifecycle.births(t)).select("frame_idx", "is_referee", "track_id", "confidence", "age")


@query(f"{S.candidates()} SELECT frame_idx, det_id, track_id, state, {S.milli('i')} AS iou_milli, {S.milli('score')} AS score_milli, rank FROM cand")
def track_candidates(spark, d):
    out = matching.candidates(T.detections(spark, d), T.tracks(spark, d))
    return out.select("frame_idx", "det_id", "track_id", "state", milli(F.col("iou")).alias("iou_milli"), milli(F.col("score")).alias("score_milli"), F.col("rank").cast("long").alias("rank"))


@query(f"""
{S.candidates()},
one AS (SELECT det_id, rank, track_id, state, CAST(floor(i * 100 + 0.50037::double) AS BIGINT) AS c, CAST(floor(d + 0.50037::double) AS BIGINT) AS w FROM cand WHERE rank <= 5),
txt AS (SELECT det_id, '[' || string_agg(track_id || ':' || state || ':iou=' || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ':d=' || w, ',' ORDER BY rank) || ']' AS s FROM one GROUP BY 1)
SELECT frame_idx, tg.det_id, coalesce(s, '[]') AS candidates FROM tg LEFT JOIN txt ON txt.det_id = tg.det_id
""")
def candidate_text(spark, d):
    det = T.detections(spark, d)
    return matching.candidate_text(det, matching.candidates(det, T.tracks(spark, d))).select("frame_idx", "det_id", "candidates")


@query(f"""
{S.TARGETS}
SELECT t.frame_idx, t.is_referee, t.track_id, g.det_id, CAST(coalesce(g.class_id, 3) AS BIGINT) AS class_id, {S.milli('coalesce(' + S.iou('t.', 'g.') + ', 0)')} AS iou_milli
FROM trk t LEFT JOIN tg g ON g.frame_idx = t.frame_idx AND g.is_referee = t.is_referee
QUALIFY row_number() OVER (PARTITION BY t.frame_idx, t.is_referee, t.track_id ORDER BY coalesce({S.iou('t.', 'g.')}, 0) DESC, g.det_id NULLS LAST) = 1
""")
def source_match(spark, d):
    return matching.source_match(T.tracks(spark, d), T.detections(spark, d)).select("frame_idx", "is_referee", "track_id", "det_id", F.col("class_id").cast("long").alias("class_id"), milli(F.col("iou")).alias("iou_milli"))


_NEAR = f"EXISTS (SELECT 1 FROM trk t WHERE NOT t.is_referee AND t.game_id = g.game_id AND t.frame_idx + 1 = g.frame_idx AND ({S.iou('g.', 't.')} >= 0.10 OR {S.dist('g.', 't.')} <= 140))"


@query(f"SELECT g.frame_idx, g.det_id FROM det g WHERE class_id IN (3, 4, 5, 6, 7) AND {_NEAR}")
def near_track(spark, d):
    return matching.near_track(T.detections(spark, d), T.tracks(spark, d)).select("frame_idx", "det_id")


def _at(k: str, y: str) -> str:
    """x at a height on the segment between points k and k + 1 of list p."""
    return f"p[{k}].x + ({y} - p[{k}].y) / CAST(p[{k} + 1].y - p[{k}].y AS DOUBLE) * (p[{k} + 1].x - p[{k}].x)"


def _line(p: str) -> str:
    """x on the line through a list of points in order of y, at the height cy: the ends are drawn on; where an end's two points have one
    height, the outer one's x."""
    body = f"""CASE WHEN coalesce(len(p), 0) = 0 THEN 0 WHEN len(p) = 1 THEN p[1].x
  WHEN cy <= p[1].y THEN CASE WHEN p[1].y = p[2].y THEN p[1].x ELSE {_at('1', 'cy')} END
  WHEN cy >= p[-1].y THEN CASE WHEN p[-1].y = p[-2].y THEN p[-1].x ELSE {_at('len(p) - 1', 'cy')} END
  ELSE {_at('len(list_filter(p, lambda q: q.y < cy))', 'cy')} END"""
    return "(" + body.replace("p[", f"{p}[").replace("len(p)", f"len({p})").replace("list_filter(p,", f"list_filter({p},") + ")"


_BOUNDS = """bp AS (SELECT * FROM vw WHERE x > 0 AND y > 0 AND conf >= 0.3),
bd AS (SELECT game_id, frame_idx, list({'y': y, 'i': kp_idx, 'x': x} ORDER BY y, kp_idx) FILTER (kp_idx BETWEEN 0 AND 5) AS lf, list({'y': y, 'i': kp_idx, 'x': x} ORDER BY y, kp_idx) FILTER (kp_idx BETWEEN 27 AND 32) AS rt,
  coalesce(min(y) FILTER (kp_idx IN (0, 15, 27)), min(y) FILTER (kp_idx NOT IN (9, 11, 21, 23))) AS top, max(y) FILTER (kp_idx IN (5, 17, 32)) AS bottom FROM bp GROUP BY ALL)"""


def _inside(rows: str) -> str:
    return f"""{_BOUNDS},
bx AS (SELECT r.*, lf, rt, top, bottom, (r.y1 + r.y2) * 0.5::double AS cy FROM {rows} r LEFT JOIN bd USING (game_id, frame_idx)),
ins AS (SELECT *, NOT (coalesce(len(lf) > 0 AND x2 < {_line('lf')}, false) OR coalesce(len(rt) > 0 AND x1 > {_line('rt')}, false) OR coalesce(y2 < top, false) OR coalesce(y2 > bottom, false)) AS inside FROM bx)"""


#: Boxes that lie in and around the views' court.
_BOXES = "bxs AS (SELECT game_id, frame_idx, kp_idx AS box_id, (frame_idx * 37 + kp_idx * 53) % 1300 - 40 AS x1, (frame_idx * 29 + kp_idx * 31) % 700 AS y1, (frame_idx * 37 + kp_idx * 53) % 1300 + 20 AS x2, (frame_idx * 29 + kp_idx * 31) % 700 + 150 AS y2 FROM vw)"


@query(f"{_BOXES}, {_inside('bxs')} SELECT frame_idx, box_id, inside FROM ins")
def court_boundary(spark, d):
    v = T.views(spark, d)
    f, i = F.col("frame_idx"), F.col("kp_idx")
    x, y = (f * 37 + i * 53) % 1300, (f * 29 + i * 31) % 700
    boxes = v.select("game_id", "frame_idx", F.col("kp_idx").cast("long").alias("box_id"), (x - 40).alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 150).alias("y2"))
    return court.inside_boundaries(boxes, court.boundaries(v.where("conf >= 0.3"))).select("frame_idx", "box_id", "inside")


@query(f"{_inside('det')} SELECT g.frame_idx, g.det_id, CAST(g.class_id AS BIGINT) AS class_id FROM ins g WHERE class_id NOT IN (3, 4, 5, 6, 7) OR inside OR {_NEAR}")
def court_filter(spark, d):
    det = T.detections(spark, d)
    bounds = court.boundaries(T.views(spark, d).where("conf >= 0.3"))
    return court.keep_on_court(det, bounds, matching.near_track(det, T.tracks(spark, d))).select("frame_idx", "det_id", F.col("class_id").cast("long").alias("class_id"))


@query("SELECT frame_idx, det_id, x2 - x1 AS w, y2 - y1 AS h, confidence FROM det WHERE class_id = 2 AND confidence >= 0.4 AND x2 - x1 >= 10 AND y2 - y1 >= 10")
def number_boxes(spark, d):
    return matching.number_boxes(T.detections(spark, d)).select("frame_idx", "det_id", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "confidence")


@query("""
n AS (SELECT frame_idx, det_id, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM det WHERE class_id = 2 AND confidence >= 0.4)
SELECT n.frame_idx, n.det_id, n.cx, n.cy, t.track_id FROM n JOIN trk t ON t.frame_idx = n.frame_idx AND NOT t.is_referee AND cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2
QUALIFY row_number() OVER (PARTITION BY n.det_id ORDER BY t.obs_id) = 1
""")
def box_contains(spark, d):
    return matching.containing_track(matching.number_boxes(T.detections(spark, d)), T.tracks(spark, d)).drop("game_id")


_RAISED = "CAST(round_even({}, 0) AS BIGINT)".format


@query(f"""
SELECT det_id, greatest(0, {_RAISED('x1 - greatest(1, x2 - x1) * 0.20::double')}) AS ex1, greatest(0, {_RAISED('y1 - greatest(1, y2 - y1) * 0.20::double')}) AS ey1,
  least(1280, {_RAISED('x2 + greatest(1, x2 - x1) * 0.20::double')}) AS ex2, least(720, {_RAISED('y2 + greatest(1, y2 - y1) * 0.20::double')}) AS ey2,
  greatest(0, (x1 + x2) // 2 - CAST(floor((x2 - x1) * 1.5::double) AS BIGINT) // 2) AS cx1, least(1280, (x1 + x2) // 2 + CAST(floor((x2 - x1) * 1.5::double) AS BIGINT) // 2) AS cx2,
  (x1 + x2) / 2.0::double AS foot_x, greatest(y1, y2 - 3) AS foot_y, y1 + CAST(floor((y2 - y1) * 0.20::double) AS BIGINT) AS jersey_top, y1 + CAST(floor((y2 - y1) * 0.65::double) AS BIGINT) AS jersey_end FROM det
""")
def box_projections(spark, d):
    b = G.box()
    e, c, f, j = G.expand(b, CFG.expand_ratio, CFG.frame_w, CFG.frame_h), G.ocr_crop(b, CFG.ocr_scale, CFG.frame_w, CFG.frame_h), G.foot(b), G.jersey_crop(b)
    return T.detections(spark, d).select("det_id", e[0].alias("ex1"), e[1].alias("ey1"), e[2].alias("ex2"), e[3].alias("ey2"), c[0].alias("cx1"), c[2].alias("cx2"), f[0].alias("foot_x"), f[1].alias("foot_y"), j[0].alias("jersey_top"), j[1].alias("jersey_end"))


_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREAS = "greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) + greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1))"


@query(f"SELECT a.det_id, {S.milli(f'CAST({_INTER} AS DOUBLE) / greatest(1, {_AREAS} - {_INTER})')} AS iou_milli FROM det a JOIN det b ON b.det_id = a.det_id + 1 AND b.frame_idx = a.frame_idx")
def iou_tlwh_next(spark, d):
    t = T.detections(spark, d).select("game_id", "frame_idx", "det_id", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    a, b = matching.renamed(t, "a_"), matching.renamed(t, "b_")
    cols = lambda p: [F.col(f"{p}{c}") for c in ("x1", "y1", "w", "h")]
    return a.join(b, ["game_id", "frame_idx"]).where("b_det_id = a_det_id + 1").select(F.col("a_det_id").alias("det_id"), milli(G.iou_tlwh(cols("a_"), cols("b_"))).alias("iou_milli"))


def owners(spark, d):
    """Which player's mask a mask is: that of the crowd's track it was made of, for three in four."""
    t = T.crowd(spark, d).where("NOT is_referee AND obs_id % 4 <> 0")
    return t.select("game_id", "frame_idx", "track_id", (F.col("obs_id") % 1000 + 1).alias("mask_id"))


OWNERS = "ow AS (SELECT game_id, frame_idx, track_id, obs_id % 1000 + 1 AS mask_id FROM crw WHERE NOT is_referee AND obs_id % 4 <> 0)"


@query(f"""
{S.births('crw')}, {OWNERS},
t AS (SELECT crw.*, frame_idx - birth_frame >= 8 OR ow.mask_id IS NOT NULL AS bars FROM crw JOIN births USING (game_id, is_referee, track_id) LEFT JOIN ow USING (game_id, frame_idx, track_id)),
c AS (SELECT a.frame_idx, a.is_referee, a.track_id, b.track_id AS by_track, b.obs_id, {S.iou('a.', 'b.')} AS i, {S.dist('a.', 'b.')} AS dd, greatest(55.0::double, 0.30::double * greatest(a.y2 - a.y1, b.y2 - b.y1)) AS lim
  FROM t a JOIN t b ON a.frame_idx = b.frame_idx AND a.is_referee = b.is_referee AND a.track_id <> b.track_id AND b.bars)
SELECT frame_idx, is_referee, track_id, by_track, {S.milli('i')} AS iou_milli, {S.milli('dd')} AS dist_milli FROM c WHERE i >= 0.08 OR dd <= lim
QUALIFY row_number() OVER (PARTITION BY frame_idx, is_referee, track_id ORDER BY greatest(i / 0.08::double, lim / greatest(dd, 1.0::double)) DESC, obs_id) = 1
""")
def isolation_blockers(spark, d):
    t = T.crowd(spark, d)
    out = matching.blockers(t, lifecycle.births(t), owners(spark, d))
    return out.select("frame_idx", "is_referee", "track_id", "by_track", milli(F.col("iou")).alias("iou_milli"), milli(F.col("dist")).alias("dist_milli"))


#: The mask with most pixels in each box, its area, and its pixels in the box grown by 20 % on each side.
DOMINANT = f"""wide AS (SELECT *, greatest(0, {_RAISED('x1 - greatest(1, x2 - x1) * 0.20::double')}) AS wx1, greatest(0, {_RAISED('y1 - greatest(1, y2 - y1) * 0.20::double')}) AS wy1,
  least(1280, {_RAISED('x2 + greatest(1, x2 - x1) * 0.20::double')}) AS wx2, least(720, {_RAISED('y2 + greatest(1, y2 - y1) * 0.20::double')}) AS wy2 FROM crw),
ins0 AS (SELECT t.frame_idx, t.is_referee, t.track_id, m.mask_id, sum(least(x_end, x2) - greatest(x_start, x1)) AS inside FROM wide t JOIN mr m ON m.frame_idx = t.frame_idx AND y >= y1 AND y < y2 AND x_start < x2 AND x_end > x1 GROUP BY ALL),
top0 AS (SELECT * FROM ins0 QUALIFY row_number() OVER (PARTITION BY frame_idx, is_referee, track_id ORDER BY inside DESC, mask_id) = 1),
wd AS (SELECT t.frame_idx, t.is_referee, t.track_id, m.mask_id, sum(least(x_end, wx2) - greatest(x_start, wx1)) AS wide FROM wide t JOIN top0 q USING (frame_idx, is_referee, track_id)
  JOIN mr m ON m.frame_idx = t.frame_idx AND m.mask_id = q.mask_id AND y >= wy1 AND y < wy2 AND x_start < wx2 AND x_end > wx1 GROUP BY ALL),
ar AS (SELECT frame_idx, mask_id, sum(x_end - x_start) AS area FROM mr GROUP BY ALL),
dm AS (SELECT t.*, q.mask_id, q.inside, wd.wide, area, CAST(q.inside AS DOUBLE) / greatest(1, (x2 - x1) * (y2 - y1)) AS fill, CAST(wd.wide AS DOUBLE) / area AS inside_ratio, wd.wide >= 80 AND CAST(wd.wide AS DOUBLE) / area >= 0.35 AS ok
  FROM wide t JOIN top0 q USING (frame_idx, is_referee, track_id) JOIN wd USING (frame_idx, is_referee, track_id) JOIN ar ON ar.frame_idx = t.frame_idx AND ar.mask_id = q.mask_id)"""


#: Players beside a surer referee, in order; each that finds a valid mask that fills 0.55 of its box, of those that weren't cleared before, is dropped and clears it.
_BESIDE = f"""hp AS (SELECT p.*, row_number() OVER (PARTITION BY frame_idx ORDER BY obs_id) AS n FROM wide p WHERE NOT is_referee
  AND EXISTS (SELECT 1 FROM crw r WHERE r.is_referee AND r.frame_idx = p.frame_idx AND {S.iou('p.', 'r.')} >= 0.45 AND r.confidence >= p.confidence + 0.05::double)),
hi AS (SELECT h.frame_idx, h.n, m.mask_id, sum(least(x_end, x2) - greatest(x_start, x1)) AS inside FROM hp h JOIN mr m ON m.frame_idx = h.frame_idx AND y >= y1 AND y < y2 AND x_start < x2 AND x_end > x1 GROUP BY ALL),
hw AS (SELECT h.frame_idx, h.n, m.mask_id, sum(least(x_end, wx2) - greatest(x_start, wx1)) AS wide FROM hp h JOIN mr m ON m.frame_idx = h.frame_idx AND y >= wy1 AND y < wy2 AND x_start < wx2 AND x_end > wx1 GROUP BY ALL),
hm AS (SELECT frame_idx, n, list({{'m': mask_id, 'full': wide >= 80 AND CAST(wide AS DOUBLE) / area >= 0.35 AND CAST(inside AS DOUBLE) / greatest(1, (x2 - x1) * (y2 - y1)) >= 0.55}} ORDER BY inside DESC, mask_id) AS ms
  FROM hp JOIN hi USING (frame_idx, n) JOIN hw USING (frame_idx, n, mask_id) JOIN ar USING (frame_idx, mask_id) GROUP BY ALL),
cs(frame_idx, n, cleared, away) AS (SELECT DISTINCT frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM hp UNION ALL
  SELECT frame_idx, n, CASE WHEN hit THEN list_append(cleared, b.m) ELSE cleared END, hit FROM (SELECT *, coalesce(b.full, false) AS hit FROM (
    SELECT h.frame_idx, h.n, s.cleared, list_filter(hm.ms, lambda q: NOT list_contains(s.cleared, q.m))[1] AS b
    FROM cs s JOIN hp h ON h.frame_idx = s.frame_idx AND h.n = s.n + 1 LEFT JOIN hm ON hm.frame_idx = h.frame_idx AND hm.n = h.n)))"""


@query(f"""
{DOMINANT}, {_BESIDE}
SELECT p.frame_idx, p.track_id FROM crw p WHERE NOT p.is_referee AND NOT EXISTS (SELECT 1 FROM hp h JOIN cs ON cs.frame_idx = h.frame_idx AND cs.n = h.n WHERE cs.away AND h.frame_idx = p.frame_idx AND h.track_id = p.track_id)
""")
def ref_conflict(spark, d):
    return masks.without_referee_conflicts(T.crowd(spark, d), T.mask_runs(spark, d)).select("frame_idx", "track_id")


#: Five points of a box: at the foot in the middle and at a quarter from each side, and in the middle at 0.80 and 0.65 of the height.
FIVE = " + ".join(
    f"CAST({S.inside(S.project(f'(x1 + {x}::double * greatest(1, x2 - x1))', y, court.FIXED_H))} AS BIGINT)"
    for x, y in ((0.50, "y2"), (0.25, "y2"), (0.75, "y2"), (0.50, "(y1 + 0.80::double * greatest(1, y2 - y1))"), (0.50, "(y1 + 0.65::double * greatest(1, y2 - y1))"))
)
#: Stages: detections, those on the court, those left by suppression, tracks, those left by suppression, and those that have been active by then (two of five box points on the court).
_FUNNEL = f"""{S.TARGETS}, {_inside('tg')},
crt AS (SELECT g.* FROM ins g WHERE is_referee OR inside OR {_NEAR}), {S.greedy('crt', 'confidence DESC, det_id', S.ROLES, prefix='d_')},
{S.births()}, tb AS (SELECT trk.*, birth_frame, birth_x, birth_y, frame_idx - birth_frame AS age FROM trk JOIN births USING (game_id, is_referee, track_id)),
{S.greedy('tb', 'least(age, 60) DESC, confidence DESC, obs_id', _TRACK_BARS, prefix='t_')},
act AS (SELECT *, is_referee OR bool_or({FIVE} >= 2) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS active FROM t_kept),
n AS (SELECT frame_idx, is_referee, count(*) AS n_raw, count(*) FILTER (confidence >= 0.5) AS n_high, count(*) FILTER (confidence >= 0.1 AND confidence < 0.5) AS n_low,
  min(confidence) AS min_score, max(confidence) AS max_score, 0 AS n_court, 0 AS n_nms, 0 AS n_tracker, 0 AS n_dedupe, 0 AS n_active FROM tg GROUP BY ALL
  UNION ALL SELECT frame_idx, is_referee, 0, 0, 0, NULL, NULL, count(*), 0, 0, 0, 0 FROM crt GROUP BY ALL UNION ALL SELECT frame_idx, is_referee, 0, 0, 0, NULL, NULL, 0, count(*), 0, 0, 0 FROM d_kept GROUP BY ALL
  UNION ALL SELECT frame_idx, is_referee, 0, 0, 0, NULL, NULL, 0, 0, count(*), 0, 0 FROM trk GROUP BY ALL UNION ALL SELECT frame_idx, is_referee, 0, 0, 0, NULL, NULL, 0, 0, 0, count(*), 0 FROM t_kept GROUP BY ALL
  UNION ALL SELECT frame_idx, is_referee, 0, 0, 0, NULL, NULL, 0, 0, 0, 0, count(*) FROM act WHERE active GROUP BY ALL),
fn AS (SELECT frame_idx, is_referee, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_raw', 'n_high', 'n_low', 'n_court', 'n_nms', 'n_tracker', 'n_dedupe', 'n_active'))}, min(min_score) AS min_score, max(max_score) AS max_score FROM n GROUP BY ALL)"""


def _funnel(spark, d):
    det, t = T.detections(spark, d), T.tracks(spark, d)
    on_court = court.keep_on_court(det, court.boundaries(T.views(spark, d).where("conf >= 0.3")), matching.near_track(det, t))
    nms = suppress.judged_detections(on_court).select("game_id", "frame_idx", "is_referee", F.lit(True).alias("court"), F.col("kept").alias("nms"))
    points = tactical.court_points(suppress.judged_tracks(t, lifecycle.births(t)), court.FIXED_H)
    hit = F.col("kept") & (F.col("n_inside") >= CFG.activate_points)
    upto = Window.partitionBy("game_id", "is_referee", "track_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    active = F.col("kept") & (F.col("is_referee") | F.bool_or(hit).over(upto))
    tracked = points.select("game_id", "frame_idx", "is_referee", F.lit(True).alias("tracker"), F.col("kept").alias("dedupe"), active.alias("active"))
    return matching.funnel(det, [nms, tracked], ("court", "nms", "tracker", "dedupe", "active"))


@query(f"{_FUNNEL} SELECT * FROM fn")
def funnel_counts(spark, d):
    return _funnel(spark, d).drop("game_id")


@query(f"{_FUNNEL} SELECT frame_idx, n_raw, n_nms, n_active FROM fn WHERE NOT is_referee AND (frame_idx % 30 = 0 OR n_raw < 6 OR n_nms < 6 OR n_active < 6)")
def sampled_diagnostics(spark, d):
    players = _funnel(spark, d).where("NOT is_referee").select("frame_idx", "n_raw", "n_nms", "n_active")
    return report.sampled(players, ["n_raw", "n_nms", "n_active"], low=6)
