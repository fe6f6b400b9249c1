"""Queries of track lifecycle, identity, jersey numbers and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.config import DEFAULT as CFG
from trackweave.functions import text as X
from trackweave.functions.geometry import milli
from trackweave.operators import jersey, lifecycle, report, suppress
from trackweave.plans import sql as S
from trackweave.plans.detections import OWNERS, owners
from trackweave.plans.registry import query
from trackweave.sources import tables as T


@query(f"{S.births()} SELECT game_id, is_referee, track_id, birth_frame, birth_x, birth_y FROM births")
def births(spark, d):
    return lifecycle.births(T.tracks(spark, d)).withColumn("game_id", F.col("game_id").cast("long"))


@query(f"{S.EDGES} SELECT is_referee, track_id, frame_idx, kind, n FROM ev")
def lifecycle_edges(spark, d):
    return lifecycle.edges(T.tracks(spark, d)).select("is_referee", "track_id", "frame_idx", "kind", "n")


#: A reader that has met 500 events of each player role reads on; referees' logs it has not opened.
@query(f"""
{S.EDGES}, lg AS (SELECT *, row_number() OVER (PARTITION BY game_id, is_referee ORDER BY frame_idx, kind, track_id) AS event_no FROM ev)
SELECT is_referee, track_id, frame_idx, kind, event_no FROM lg WHERE event_no > CASE WHEN is_referee THEN 0 ELSE 500 END
""")
def event_cursor(spark, d):
    t = T.tracks(spark, d)
    cursors = t.where("NOT is_referee").select("game_id", "is_referee").distinct().withColumn("cursor", F.lit(500))
    return lifecycle.unread(lifecycle.event_log(lifecycle.edges(t)), cursors).select("is_referee", "track_id", "frame_idx", "kind", F.col("event_no").cast("long").alias("event_no"))


@query(f"{S.EDGES} SELECT is_referee, track_id, frame_idx, n, n > 90 AS long_gap FROM ev WHERE kind = 'recovered'")
def recovery_gaps(spark, d):
    return lifecycle.recoveries(lifecycle.edges(T.tracks(spark, d))).select("is_referee", "track_id", "frame_idx", "n", "long_gap")


_SWITCHES = "sw AS (SELECT game_id, is_referee FROM links UNION ALL SELECT game_id, is_referee FROM rsw)"
_SUMMARY = f"""{S.EDGES}, {S.LINKS_ONLY}, {S.REC}, {_SWITCHES},
tot AS (SELECT game_id, is_referee, count(*) FILTER (kind = 'new') AS n_new, count(*) FILTER (kind = 'lost') AS n_lost, count(*) FILTER (kind = 'recovered') AS n_recovered, count(*) FILTER (kind = 'removed') AS n_removed FROM ev GROUP BY ALL),
summ AS (SELECT t.*, (SELECT count(*) FROM sw WHERE sw.game_id = t.game_id AND sw.is_referee = t.is_referee) AS n_switches FROM tot t)"""


def _summary(spark, d):
    t = T.tracks(spark, d)
    out = lifecycle.summary(lifecycle.edges(t), lifecycle.switches(t))
    return out.select(F.col("game_id").cast("long").alias("game_id"), "is_referee", "n_new", "n_lost", "n_recovered", "n_removed", "n_switches")


@query(f"{_SUMMARY} SELECT * FROM summ")
def lifecycle_summary(spark, d):
    return _summary(spark, d)


@query(f"""
{_SUMMARY}
SELECT '{{"game_id":' || game_id || ',"is_referee":' || CAST(is_referee AS VARCHAR) || ',"n_new":' || n_new || ',"n_lost":' || n_lost || ',"n_recovered":' || n_recovered
  || ',"n_removed":' || n_removed || ',"n_switches":' || n_switches || '}}' AS json FROM summ
""")
def summary_json(spark, d):
    return report.as_json(_summary(spark, d))


@query(f"{S.SEEN}, {S.REC} SELECT is_referee, track_id, frame_idx, lost_for, {S.milli('dist')} AS dist_milli FROM rsw")
def recovered_switches(spark, d):
    return lifecycle.recovered_switches(T.tracks(spark, d)).select("is_referee", "track_id", "frame_idx", "lost_for", milli(F.col("dist")).alias("dist_milli"))


@query(f"""
{S.EDGES}, l AS (SELECT game_id, is_referee, list_sort(list(n)) AS s FROM ev WHERE kind = 'removed' GROUP BY ALL), r AS (SELECT DISTINCT game_id, is_referee FROM ev)
SELECT r.game_id, r.is_referee, CAST(coalesce(len(s), 0) AS BIGINT) AS n_removed, {S.milli('coalesce(list_avg(s), 0)')} AS mean_milli, coalesce(s[len(s) // 2 + 1], 0) AS median_life,
  coalesce(s[CAST(floor(len(s) * 0.9::double) AS BIGINT) + 1], 0) AS p90_life FROM r LEFT JOIN l USING (game_id, is_referee)
""")
def lifetime_stats(spark, d):
    out = lifecycle.lifetimes(lifecycle.edges(T.tracks(spark, d)))
    return out.select(F.col("game_id").cast("long").alias("game_id"), "is_referee", "n_removed", milli(F.col("mean_life")).alias("mean_milli"), "median_life", "p90_life")


@query(f"""
{S.EDGES} SELECT is_referee, track_id, frame_idx, n AS life, row_number() OVER w AS rank FROM ev WHERE kind = 'removed'
WINDOW w AS (PARTITION BY game_id, is_referee ORDER BY n, frame_idx, track_id) QUALIFY rank <= 10
""")
def shortest_lived(spark, d):
    return lifecycle.shortest_lived(lifecycle.edges(T.tracks(spark, d))).select("is_referee", "track_id", "frame_idx", "life", F.col("rank").cast("long").alias("rank"))


@query(f"""
{S.EDGES}, c AS (SELECT game_id, is_referee, track_id, count(*) AS n_recovered, min(frame_idx) AS first_frame FROM ev WHERE kind = 'recovered' GROUP BY ALL)
SELECT is_referee, track_id, n_recovered, first_frame, row_number() OVER w AS rank FROM c WINDOW w AS (PARTITION BY game_id, is_referee ORDER BY n_recovered DESC, first_frame, track_id) QUALIFY rank <= 10
""")
def most_recovered(spark, d):
    return lifecycle.most_recovered(lifecycle.edges(T.tracks(spark, d))).select("is_referee", "track_id", "n_recovered", "first_frame", F.col("rank").cast("long").alias("rank"))


#: Removed tracks of whose last rows every fifth still had a mask; these are no sources.
@query(f"{S.LINKS.replace('> frame_idx + 1) AND (source_kind', '> frame_idx + 1) AND NOT (source_kind = ' + chr(39) + 'rm' + chr(39) + ' AND obs_id % 5 = 0) AND (source_kind')} SELECT is_referee, frame_idx, source_kind, source_id, new_id, {S.milli('dist')} AS dist_milli, dt FROM links")
def switch_links(spark, d):
    t = T.tracks(spark, d)
    holding = t.where("obs_id % 5 = 0").select("game_id", "is_referee", "track_id", (F.col("frame_idx") + CFG.buffer + 1).alias("frame_idx"))
    return lifecycle.switch_links(t, CFG, holding).select("is_referee", "frame_idx", "source_kind", "source_id", "new_id", milli(F.col("dist")).alias("dist_milli"), "dt")


_STABLE = f"""{S.LINKS},
al AS (SELECT t.*, CASE WHEN t.is_referee THEN t.track_id ELSE coalesce((SELECT l.source_id FROM links l WHERE NOT l.is_referee AND l.game_id = t.game_id AND l.new_id = t.track_id AND l.frame_idx <= t.frame_idx
  ORDER BY l.frame_idx DESC LIMIT 1), t.track_id) END AS stable_id FROM trk t)"""


@query(f"{_STABLE} SELECT frame_idx, is_referee, track_id, stable_id FROM al")
def alias_apply(spark, d):
    t = T.tracks(spark, d)
    return lifecycle.apply_aliases(t, lifecycle.switch_links(t)).select("frame_idx", "is_referee", "track_id", "stable_id")


@query(f"""
{_STABLE}, p AS (SELECT * FROM al WHERE NOT is_referee),
rep AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame_idx, stable_id ORDER BY track_id DESC) = 1),
j AS (SELECT p.frame_idx, p.game_id, p.stable_id, b.stable_id IS NULL AS fresh, {S.dist('p.', 'b.')} >= 90 AS jump, b.track_id <> p.track_id AS raw_changed, o.stable_id <> p.stable_id AS map_changed
  FROM p LEFT JOIN rep b ON b.game_id = p.game_id AND b.frame_idx + 1 = p.frame_idx AND b.stable_id = p.stable_id LEFT JOIN p o ON o.game_id = p.game_id AND o.frame_idx + 1 = p.frame_idx AND o.track_id = p.track_id),
n AS (SELECT frame_idx, game_id, count(*) AS n_ids, count(*) FILTER (fresh) AS n_new, count(*) FILTER (jump) AS n_jumps, count(*) FILTER (raw_changed) AS n_raw_changed, count(*) FILTER (map_changed) AS n_map_changed,
  count(DISTINCT stable_id) FILTER (NOT fresh) AS stay FROM j GROUP BY ALL),
m AS (SELECT game_id, frame_idx + 1 AS frame_idx, count(*) AS c FROM rep GROUP BY ALL)
SELECT n.frame_idx, n_ids, n_new, n_jumps, n_raw_changed, n_map_changed, coalesce(c, 0) - stay AS n_lost FROM n LEFT JOIN m USING (game_id, frame_idx)
""")
def id_jumps(spark, d):
    t = T.tracks(spark, d)
    return lifecycle.id_diagnostics(lifecycle.apply_aliases(t, lifecycle.switch_links(t))).drop("game_id")


def _cross(a: str, b: str) -> str:
    return f"sqrt(power(({a}.bx1 + {a}.bx2) / 2.0::double - ({b}.x1 + {b}.x2) / 2.0::double, 2) + power(({a}.by1 + {a}.by2) / 2.0::double - ({b}.y1 + {b}.y2) / 2.0::double, 2))"


#: The crowd's players, who change places every frame, under ids of which each stands for two raw ones.
@query(f"""
p AS (SELECT game_id, frame_idx, raw % 75 AS track_id, nx AS x1, y1, nx + x2 - x1 AS x2, y2 FROM (SELECT *, track_id AS raw, ((track_id + frame_idx) % 2) * 150 + (obs_id * 7) % 23 AS nx FROM crw WHERE NOT is_referee)
  QUALIFY row_number() OVER (PARTITION BY game_id, frame_idx, raw % 75 ORDER BY raw DESC) = 1),
t AS (SELECT p.*, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM p JOIN p b ON b.track_id = p.track_id AND b.frame_idx + 1 = p.frame_idx AND b.game_id = p.game_id),
s AS (SELECT a.frame_idx, a.track_id AS a_id, b.track_id AS b_id, {_cross('a', 'a')} + {_cross('b', 'b')} AS own, {_cross('a', 'b')} + {_cross('b', 'a')} AS crossed FROM t a JOIN t b ON a.frame_idx = b.frame_idx AND a.track_id < b.track_id)
SELECT frame_idx, a_id, b_id, {S.milli('own')} AS own_milli, {S.milli('crossed')} AS crossed_milli FROM s WHERE crossed + 70 < own
""")
def possible_swaps(spark, d):
    t = T.crowd(spark, d).withColumn("w", F.col("x2") - F.col("x1")).withColumn("x1", ((F.col("track_id") + F.col("frame_idx")) % 2) * 150 + (F.col("obs_id") * 7) % 23).withColumn("x2", F.col("x1") + F.col("w"))
    return lifecycle.possible_swaps(t.withColumn("stable_id", F.col("track_id") % 75)).select("frame_idx", "a_id", "b_id", milli(F.col("own")).alias("own_milli"), milli(F.col("crossed")).alias("crossed_milli"))


@query("""
b AS (SELECT game_id, is_referee, frame_idx + 1 AS frame_idx, track_id FROM trk), n AS (SELECT game_id, is_referee, frame_idx, track_id FROM trk),
u AS (SELECT *, 'came' AS kind FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'went' FROM (SELECT * FROM b EXCEPT SELECT * FROM n) WHERE (game_id, frame_idx) IN (SELECT game_id, frame_idx FROM trk)
  UNION ALL SELECT *, 'stayed' FROM (SELECT * FROM n INTERSECT SELECT * FROM b))
SELECT is_referee, frame_idx, track_id, kind FROM u
""")
def id_set_changes(spark, d):
    return lifecycle.changes(T.tracks(spark, d)).select("is_referee", "frame_idx", "track_id", "kind")


#: After each frame of a game: every track seen in it or within the buffer of 120 frames before, active ones first.
_STATE = """fr AS (SELECT DISTINCT game_id, frame_idx FROM trk),
u AS (SELECT t.game_id, t.is_referee, f.frame_idx, t.track_id, max(t.frame_idx) AS last_frame FROM fr f JOIN trk t ON t.game_id = f.game_id AND t.frame_idx BETWEEN f.frame_idx - 120 AND f.frame_idx GROUP BY ALL)"""


@query(f"{_STATE} SELECT is_referee, frame_idx, track_id, CASE WHEN last_frame = frame_idx THEN 'active' ELSE 'lost' END AS state, last_frame FROM u")
def active_and_lost(spark, d):
    return lifecycle.active_and_lost(T.tracks(spark, d)).drop("game_id")


@query(f"""
{_STATE}, {OWNERS},
rm AS (SELECT game_id, is_referee, track_id, frame_idx + 121 AS at FROM (SELECT *, lead(frame_idx) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS nx FROM trk) WHERE nx IS NULL OR nx > frame_idx + 121),
c AS (SELECT game_id, frame_idx, count(*) FILTER (last_frame = frame_idx) AS n_active, count(*) FILTER (last_frame < frame_idx) AS n_lost FROM u GROUP BY ALL)
SELECT frame_idx, n_active, n_lost, (SELECT count(*) FROM rm WHERE rm.game_id = c.game_id AND rm.at <= c.frame_idx) AS n_removed, (SELECT count(*) FROM ow WHERE ow.frame_idx = c.frame_idx) AS n_masks FROM c
""")
def tracker_gauges(spark, d):
    return lifecycle.gauges(T.tracks(spark, d), owners(spark, d)).drop("game_id")


@query(f"{S.VOTES} SELECT det_id, text, number FROM cl")
def jersey_clean(spark, d):
    return jersey.cleaned(T.ocr_reads(spark, d)).select("det_id", "text", "number")


@query(f"{S.VOTES} SELECT game_id, track_id, number, count(*) AS n_votes, min(frame_idx) AS first_frame FROM vt GROUP BY ALL")
def jersey_votes(spark, d):
    return jersey.counts(jersey.votes(T.ocr_reads(spark, d))).withColumn("game_id", F.col("game_id").cast("long"))


@query(f"{S.VOTES} SELECT track_id, lock_frame, owner, voted, CASE WHEN owner <= 2 THEN voted END AS jersey FROM lk")
def jersey_final(spark, d):
    return jersey.locks(jersey.votes(T.ocr_reads(spark, d))).select("track_id", "lock_frame", F.col("owner").cast("long").alias("owner"), "voted", "jersey")


@query(f"{S.VOTES} SELECT voted AS jersey, track_id FROM lk WHERE owner = 1")
def find_by_jersey(spark, d):
    return jersey.by_number(jersey.locks(jersey.votes(T.ocr_reads(spark, d)))).select("jersey", "track_id")


@query(f"""
{S.VOTES} SELECT t.frame_idx, t.is_referee, t.track_id, CASE WHEN NOT t.is_referee AND t.frame_idx >= lock_frame AND owner <= 2 THEN voted END AS jersey FROM trk t LEFT JOIN lk USING (game_id, track_id)
""")
def jersey_labels(spark, d):
    return jersey.labelled(T.tracks(spark, d), jersey.locks(jersey.votes(T.ocr_reads(spark, d)))).select("frame_idx", "is_referee", "track_id", "jersey")


@query(f"""
{S.VOTES}
SELECT t.frame_idx, t.track_id, t.is_referee, CASE WHEN t.is_referee THEN 'REF' WHEN t.frame_idx >= lock_frame AND owner <= 2 THEN '#' || voted ELSE CAST(t.track_id AS VARCHAR) END AS label, t.x1, t.y1, t.x2, t.y2
FROM trk t LEFT JOIN lk USING (game_id, track_id)
""")
def annotations(spark, d):
    named = jersey.labelled(T.tracks(spark, d), jersey.locks(jersey.votes(T.ocr_reads(spark, d))))
    return named.select("frame_idx", "track_id", "is_referee", X.display_label(F.col("track_id"), F.col("jersey"), F.col("is_referee")).alias("label"), "x1", "y1", "x2", "y2")


#: Hue by golden-ratio steps over 60 ids, saturation 0.85, value 0.95; p, q and t of the usual conversion.
@query("""
u AS (SELECT event_id, event_type, user_id, ((user_id % 60) * 0.618033988749895::double) % 1.0::double * 6 AS h6 FROM events),
v AS (SELECT *, CAST(floor(h6) AS BIGINT) AS s, h6 - floor(h6) AS f FROM u),
w AS (SELECT *, 0.95::double * 255 AS v, 0.95::double * (1 - 0.85::double) * 255 AS p, 0.95::double * (1 - 0.85::double * f) * 255 AS q, 0.95::double * (1 - 0.85::double * (1 - f)) * 255 AS t FROM v),
c AS (SELECT *, lower((['Player-ball', 'REFEREE', 'ref-2', 'basketball', 'Rim', 'hoop', 'number', 'Coach'])[event_id % 8 + 1]) AS nm, CAST(floor(v) AS BIGINT) AS iv, CAST(floor(p) AS BIGINT) AS ip, CAST(floor(q) AS BIGINT) AS iq, CAST(floor(t) AS BIGINT) AS it FROM w)
SELECT event_id, CAST(CASE WHEN nm LIKE '%player%' THEN 3 WHEN nm LIKE '%referee%' THEN 8 WHEN nm LIKE '%ref%' THEN 8 WHEN nm LIKE '%ball%' THEN 0 WHEN nm LIKE '%rim%' THEN 9 WHEN nm LIKE '%hoop%' THEN 9
  WHEN event_id % 3 = 0 THEN 99 ELSE event_id % 7 END AS BIGINT) AS class_id, CASE event_type WHEN 'signup' THEN 'REF' ELSE coalesce('#' || nullif(CAST(event_id % 4 AS VARCHAR), '0'), CAST(user_id AS VARCHAR)) END AS label,
  CASE event_type WHEN 'signup' THEN user_id + 1000 ELSE user_id END AS role_id,
  CASE s WHEN 0 THEN iv * 65536 + it * 256 + ip WHEN 1 THEN iq * 65536 + iv * 256 + ip WHEN 2 THEN ip * 65536 + iv * 256 + it WHEN 3 THEN ip * 65536 + iq * 256 + iv
    WHEN 4 THEN it * 65536 + ip * 256 + iv ELSE iv * 65536 + ip * 256 + iq END AS color FROM c
""")
def labels_and_colors(spark, d):
    ref, e = F.col("event_type") == "signup", T.events(spark, d)
    number = F.nullif((F.col("event_id") % 4).cast("string"), F.lit("0"))
    names = F.array(*map(F.lit, ("Player-ball", "REFEREE", "ref-2", "basketball", "Rim", "hoop", "number", "Coach")))
    name = F.get(names, (F.col("event_id") % 8).cast("int"))
    return e.select("event_id", X.class_of(name, F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 7).cast("int"))).cast("long").alias("class_id"), X.display_label(F.col("user_id"), number, ref).alias("label"), X.role_id(F.col("user_id"), ref).alias("role_id"), X.color(F.col("user_id")).cast("long").alias("color"))


_LEDGER = "led AS (SELECT game_id, frame_idx, nullif(track_id % 12, 11) AS dropped_id, nullif(obs_id % 3, 2) AS kept_id FROM trk)"


def _ledger(spark, d):
    return T.tracks(spark, d).select("game_id", "frame_idx", F.nullif(F.col("track_id") % 12, F.lit(11)).alias("dropped_id"), F.nullif(F.col("obs_id") % 3, F.lit(2)).alias("kept_id"))


@query(f"""
{_LEDGER}, two AS (SELECT * FROM led WHERE dropped_id IS NULL OR kept_id IS NULL OR dropped_id <> kept_id),
r AS (SELECT game_id, dropped_id, kept_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY game_id, dropped_id, kept_id ORDER BY frame_idx) AS g FROM (SELECT DISTINCT * FROM two)),
i AS (SELECT game_id, dropped_id, kept_id, g, count(*) AS run, min(frame_idx) AS s FROM r GROUP BY ALL),
b AS (SELECT game_id, dropped_id, kept_id, run, s FROM i QUALIFY row_number() OVER (PARTITION BY game_id, dropped_id, kept_id ORDER BY run DESC, s) = 1),
t AS (SELECT game_id, dropped_id, kept_id, count(*) AS total FROM two GROUP BY ALL)
SELECT t.dropped_id, t.kept_id, total, run AS longest_run, s AS run_start FROM t JOIN b ON t.game_id = b.game_id AND t.dropped_id IS NOT DISTINCT FROM b.dropped_id AND t.kept_id IS NOT DISTINCT FROM b.kept_id
WHERE run >= 5 OR total >= 10
""")
def suppress_islands(spark, d):
    return report.islands(_ledger(spark, d)).drop("game_id")


@query(f"""
{S.BYPASS}, led AS (SELECT x.game_id, x.frame_idx, x.top_track AS a, k.top_track AS b FROM gone JOIN ord x ON x.g = gone.g AND x.n = gone.xn JOIN ord k ON k.g = gone.g AND k.n = gone.kn),
p AS (SELECT game_id, a AS track_id, count(*) AS total, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM led WHERE a = b GROUP BY ALL)
SELECT track_id, total, first_frame, last_frame, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY game_id ORDER BY total DESC, first_frame, track_id) QUALIFY rank <= 10
""")
def duplicate_report(spark, d):
    t = T.tracks(spark, d)
    return report.duplicates(suppress.tracked_ledger(T.detections(spark, d), t, lifecycle.births(t))).select("track_id", "total", "first_frame", "last_frame", F.col("rank").cast("long").alias("rank"))


@query(f"{S.LINKS} SELECT is_referee, count(*) AS n FROM links GROUP BY 1")
def switch_counts(spark, d):
    return lifecycle.switch_links(T.tracks(spark, d)).groupBy("is_referee").agg(F.count("*").alias("n"))
