"""DuckDB SQL of the registered queries, in pieces; a query's SQL begins with the common tables of `sources.tables.SQL` that it names."""

from __future__ import annotations

import re

from trackweave.sources.tables import NEEDS, SQL


def iou(a: str, b: str) -> str:
    inter = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"greatest(1, ({p}x2 - {p}x1) * ({p}y2 - {p}y1))"
    return f"(CASE WHEN least({a}x2, {b}x2) > greatest({a}x1, {b}x1) AND least({a}y2, {b}y2) > greatest({a}y1, {b}y1) THEN CAST({inter} AS DOUBLE) / ({area(a)} + {area(b)} - {inter}) ELSE 0::double END)"


def dist(a: str, b: str) -> str:
    dx, dy = (f"(({a}{c}1 + {a}{c}2) / 2.0::double - ({b}{c}1 + {b}{c}2) / 2.0::double)" for c in "xy")
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def milli(v: str) -> str:
    return f"CAST(floor(({v}) * 1000.0::double + 0.50037::double) AS BIGINT)"


def project(x: str, y: str, h: list[float]) -> tuple[str, str]:
    g = [f"{v!r}::double" for v in h]
    w = f"({g[6]} * {x} + {g[7]} * {y} + {g[8]})"
    return f"(({g[0]} * {x} + {g[1]} * {y} + {g[2]}) / {w})", f"(({g[3]} * {x} + {g[4]} * {y} + {g[5]}) / {w})"


def inside(p: tuple[str, str]) -> str:
    return f"({p[0]} >= 0 AND {p[0]} < 300 AND {p[1]} >= 0 AND {p[1]} < 161)"


def with_tables(body: str) -> str:
    """The query with the common tables that it names, and those that they need."""
    named = {t for t in SQL if re.search(rf"\b{t}\b", body)}
    named |= {n for t in named for n in NEEDS.get(t, ())}
    own = body.strip()
    tables = ",\n".join(f"{t} AS ({SQL[t]})" for t in SQL if t in named)
    if own.startswith("SELECT"):
        return f"WITH RECURSIVE {tables}\n{own}" if named else own
    return f"WITH RECURSIVE {tables}{',' if named else ''}\n{own}"


def greedy(source: str, order: str, bars: str, group: str = "frame_idx", prefix: str = "") -> str:
    """Tables `kept` and `gone` of a greedy suppression of the rows of `source` within groups: a row is dropped if a kept one before it in
    order bars it (`bars`, of rows k and x); `gone` has the numbers of both rows, of the barring one the first. Names begin with the prefix."""
    p = prefix
    return f"""
{p}ord AS (SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM {source}),
{p}bar AS (SELECT x.g, k.n AS kn, x.n AS xn FROM {p}ord k JOIN {p}ord x ON k.g = x.g AND k.n < x.n WHERE {bars}),
{p}nms(g, n, kept) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM {p}ord UNION ALL
  SELECT x.g, x.n, CASE WHEN EXISTS (SELECT 1 FROM {p}bar b WHERE b.g = x.g AND b.xn = x.n AND list_contains(s.kept, b.kn)) THEN s.kept ELSE list_append(s.kept, x.n) END
  FROM {p}nms s JOIN {p}ord x ON x.g = s.g AND x.n = s.n + 1),
{p}lists AS (SELECT g, max_by(kept, n) AS kept FROM {p}nms GROUP BY g),
{p}kept AS (SELECT o.* FROM {p}ord o JOIN {p}lists l ON l.g = o.g AND list_contains(l.kept, o.n)),
{p}gone AS (SELECT b.g, b.xn, min(b.kn) AS kn FROM {p}bar b JOIN {p}lists l ON l.g = b.g AND list_contains(l.kept, b.kn) AND NOT list_contains(l.kept, b.xn) GROUP BY ALL)"""


TARGETS = "tg AS (SELECT *, class_id = 8 AS is_referee FROM det WHERE class_id IN (3, 4, 5, 6, 7, 8))"
ROLES = f"{iou('k.', 'x.')} >= CASE WHEN k.is_referee = x.is_referee THEN 0.65::double ELSE 0.80::double END"
NMS = f"{TARGETS}, {greedy('tg', 'confidence DESC, det_id', ROLES)}"


def births(source: str = "trk") -> str:
    return f"""births AS (SELECT game_id, is_referee, track_id, frame_idx AS birth_frame, (x1 + x2) / 2.0::double AS birth_x, (y1 + y2) / 2.0::double AS birth_y
  FROM {source} QUALIFY row_number() OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) = 1)"""


def candidates(source: str = "trk") -> str:
    """Tables `cand` (each target's candidates, ranked, with ages): the previous state has every track that was seen within the buffer of 120
    frames, where it was last seen."""
    return f"""{TARGETS}, {births(source)},
later AS (SELECT *, lead(frame_idx) OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) AS again FROM {source}),
near AS (SELECT t.frame_idx, t.det_id, t.is_referee, l.game_id, l.track_id, CASE WHEN t.frame_idx = l.frame_idx + 1 THEN 'active' ELSE 'lost' END AS state, {iou('t.', 'l.')} AS i, {dist('t.', 'l.')} AS d
  FROM tg t JOIN later l ON l.game_id = t.game_id AND l.is_referee = t.is_referee AND t.frame_idx > l.frame_idx AND t.frame_idx - 1 - l.frame_idx <= 120 AND (l.again IS NULL OR l.again >= t.frame_idx)),
hits AS (SELECT *, i + CASE state WHEN 'active' THEN 0.25::double ELSE 0::double END - least(d, 500.0::double) / 5000.0::double AS score FROM near
  WHERE CASE state WHEN 'lost' THEN i >= 0.20 OR d <= 160 ELSE i >= 0.30 END),
cand AS (SELECT h.*, greatest(0, h.frame_idx - coalesce(birth_frame, h.frame_idx)) AS age, row_number() OVER (PARTITION BY det_id ORDER BY score DESC, state, track_id) AS rank
  FROM hits h LEFT JOIN births USING (game_id, is_referee, track_id))"""


YOUNG = "(({0} <= 5 AND {1} >= 8) OR ({1} <= 5 AND {0} >= 8))"
BYPASS = f"""{candidates()},
aged AS (SELECT tg.*, coalesce(c.age, 0) AS top_age, c.track_id AS top_track FROM tg LEFT JOIN cand c ON c.det_id = tg.det_id AND c.rank = 1),
both_ AS (SELECT x.det_id AS xd, k.det_id AS kd, a.age AS aa, b.age AS ab FROM tg x JOIN tg k ON k.frame_idx = x.frame_idx AND k.det_id <> x.det_id AND k.is_referee = x.is_referee AND {iou('k.', 'x.')} >= 0.65
  JOIN cand a ON a.det_id = x.det_id JOIN cand b ON b.det_id = k.det_id AND b.track_id <> a.track_id
  QUALIFY row_number() OVER (PARTITION BY x.det_id, k.det_id ORDER BY a.score + b.score DESC, a.rank, b.rank) = 1),
pass AS (SELECT xd, kd FROM both_ WHERE NOT {YOUNG.format('aa', 'ab')}),
{greedy('aged', 'least(top_age, 60) DESC, confidence DESC, det_id', f"{ROLES} AND NOT (k.is_referee = x.is_referee AND (x.det_id, k.det_id) IN (SELECT xd, kd FROM pass))")}"""

SEEN = """seen AS (SELECT *, lag(frame_idx) OVER w AS before, lead(frame_idx) OVER w AS after, first_value(frame_idx) OVER w AS birth, lag(x1) OVER w AS bx1, lag(y1) OVER w AS by1, lag(x2) OVER w AS bx2, lag(y2) OVER w AS by2
  FROM trk WINDOW w AS (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx))"""
#: A track is lost from the frame after it was last seen, for (frame - that frame) when it is seen again, and removed once it was unseen for more than 120 frames.
EDGES = f"""{SEEN}, lim AS (SELECT game_id, max(frame_idx) AS e FROM trk GROUP BY 1),
ev0 AS (SELECT game_id, is_referee, track_id, frame_idx, 'new' AS kind, 0 AS n FROM seen WHERE before IS NULL OR frame_idx - before > 121
  UNION ALL SELECT game_id, is_referee, track_id, frame_idx, 'recovered', frame_idx - (before + 1) FROM seen WHERE frame_idx - before BETWEEN 2 AND 121
  UNION ALL SELECT game_id, is_referee, track_id, frame_idx + 1, 'lost', 0 FROM seen JOIN lim USING (game_id) WHERE frame_idx + 1 < coalesce(after, e + 1)
  UNION ALL SELECT * FROM (SELECT game_id, is_referee, track_id, frame_idx + 121, 'removed', frame_idx + 121 - birth FROM seen JOIN lim USING (game_id) WHERE frame_idx + 121 < coalesce(after, e + 1)
    QUALIFY row_number() OVER (PARTITION BY game_id, is_referee, track_id ORDER BY frame_idx) = 1)),
ev AS (SELECT game_id, is_referee, track_id, frame_idx, kind, CAST(n AS BIGINT) AS n FROM ev0)"""
#: Places of lost tracks are known from the frame in which they are missed, those of removed ones from the frame after their removal, both for 60 frames.
LINKS_ONLY = """nw AS (SELECT game_id, is_referee, track_id AS new_id, frame_idx, (x1 + x2) / 2.0::double AS cx, (y1 + y2) / 2.0::double AS cy FROM seen WHERE before IS NULL OR frame_idx - before > 121),
gone AS (SELECT game_id, is_referee, track_id AS source_id, (x1 + x2) / 2.0::double AS sx, (y1 + y2) / 2.0::double AS sy, after, source_kind, frame_idx + d AS since FROM seen,
  (VALUES ('lost', 1), ('rm', 121)) k(source_kind, d) WHERE (after IS NULL OR after > frame_idx + 1) AND (source_kind = 'lost' OR after IS NULL OR frame_idx + d < after)),
cand AS (SELECT *, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS dist, frame_idx - since AS dt FROM nw JOIN gone USING (game_id, is_referee)
  WHERE frame_idx - since <= 60 AND new_id <> source_id AND CASE source_kind WHEN 'rm' THEN frame_idx > since ELSE frame_idx >= since AND (after IS NULL OR frame_idx < after) END),
rk AS (SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS second FROM cand WHERE dist <= 80 WINDOW w AS (PARTITION BY game_id, is_referee, new_id, frame_idx ORDER BY dist, dt, source_kind, source_id)),
links AS (SELECT game_id, is_referee, frame_idx, source_kind, source_id, new_id, dist, dt FROM rk WHERE r = 1 AND (second IS NULL OR second - dist >= 20))"""
LINKS = f"{SEEN}, {LINKS_ONLY}"
REC = f"""rcv AS (SELECT game_id, is_referee, track_id, frame_idx, frame_idx - (before + 1) AS lost_for, CASE WHEN frame_idx - 1 - (before + 1) <= 60 THEN {dist('', 'b')} END AS dist
  FROM seen WHERE frame_idx - before BETWEEN 2 AND 121),
rsw AS (SELECT * FROM rcv WHERE dist > 80 OR lost_for > 90)"""
VOTES = """cl AS (SELECT *, nullif(substring(regexp_replace(translate(text, 'OoQIli|ZSsB', '00011112558'), '[^0-9]', '', 'g'), 1, 2), '') AS number FROM ocr),
vt AS (SELECT *, row_number() OVER (PARTITION BY game_id, track_id, number ORDER BY frame_idx, det_id) AS nth FROM cl WHERE conf > 0.3 AND number IS NOT NULL AND frame_idx % 3 = 0),
lk0 AS (SELECT * FROM vt WHERE nth = 3 QUALIFY row_number() OVER (PARTITION BY game_id, track_id ORDER BY frame_idx, det_id) = 1),
lk AS (SELECT game_id, track_id, frame_idx AS lock_frame, number AS voted, row_number() OVER (PARTITION BY game_id, number ORDER BY frame_idx, det_id) AS owner FROM lk0)"""
#: Views whose points at the frame's border (10 pixels) are missing.
GOOD = "gv AS (SELECT game_id, frame_idx, kp_idx, conf, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT *, x >= 10 AND x < 1270 AND y >= 10 AND y < 710 AS ok FROM vw))"
MATCHED = f"{GOOD}, mt AS (SELECT gv.*, tx, ty FROM gv JOIN tpl USING (kp_idx) WHERE x IS NOT NULL)"
LAYOUT = """ln AS (SELECT *, CASE WHEN kp_idx BETWEEN 0 AND 5 THEN 'l' WHEN kp_idx BETWEEN 27 AND 32 THEN 'r' WHEN kp_idx BETWEEN 15 AND 17 THEN 'c' WHEN kp_idx IN (9, 11) THEN 'li' WHEN kp_idx IN (21, 23) THEN 'ri' END AS line
  FROM gv WHERE x > 0 AND y > 0 AND conf >= 0.10),
pr AS (SELECT a.frame_idx, CAST(b.x - a.x AS DOUBLE) / (b.y - a.y) AS s FROM ln a JOIN ln b ON a.frame_idx = b.frame_idx AND a.line = b.line AND a.kp_idx < b.kp_idx WHERE abs(b.y - a.y) >= 18),
ly AS (SELECT frame_idx, count(*) AS n_pairs, median(s) AS slope, CASE WHEN abs(median(s)) < 0.08 THEN NULL WHEN median(s) < 0 THEN 'left' ELSE 'right' END AS side FROM pr GROUP BY 1)"""
