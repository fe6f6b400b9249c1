"""Composed runs against plain loops, one point and one box at a time, over several games."""

import math
import random

import numpy as np
import pytest
from conftest import MIDDLE
from plain_masks import Plain
from test_sequential import dist, iou

from trackweave.config import DEFAULT as C
from trackweave.operators import assignment, association, court_state, homography, tactical
from trackweave.plans import runs
from trackweave.sources import court_template as T
from trackweave.sources import tables
from trackweave.sources.court_template import TEMPLATE


def inner(p):
    return p is not None and 10 <= p[0] < 1270 and 10 <= p[1] < 710


def far(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def median(v):
    v = sorted(v)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def image(h, p):
    w = h[2][0] * p[0] + h[2][1] * p[1] + h[2][2]
    return (h[0][0] * p[0] + h[0][1] * p[1] + h[0][2]) / w, (h[1][0] * p[0] + h[1][1] * p[1] + h[1][2]) / w


image_of = image


def choose(points, observed, frame, last, last_mode, reseed, stable):
    """The better of both templates: (H, mode, score, residual)."""
    at = [k for k in range(33) if points[k]]
    if len(at) < 4:
        return None
    src = np.array([points[k] or (0.0, 0.0) for k in range(33)], float)
    dst = np.array([t[1:3] for t in T.TEMPLATE], float)
    h, ok, residual = homography.estimate_all(src[None], dst[None], np.array([[bool(p) for p in points]]), np.array([frame]))
    if not ok[0]:
        return None
    best = None
    for mode in ("normal", "mirrored"):
        m = h[0].tolist()
        if mode == "mirrored":
            m = [[300 * m[2][j] - m[0][j] for j in range(3)], m[1], m[2]]
        xs = [T.TEMPLATE[k][1] if mode == "normal" else 300 - T.TEMPLATE[k][1] for k in at]
        mean = sum(xs) / len(xs)
        score = float(residual[0])
        if stable and last is not None:
            shifts = [far(image(m, p), image(last, p)) for p in ((x, y) for y in (0, 360, 719) for x in (0, 640, 1279))]
            score += 0.35 * sum(shifts) / 9 + 0.05 * max(shifts)
            if last_mode is not None and last_mode != mode and not reseed:
                score += 25
        side = "left" if mean < 129 else "right" if mean > 171 else "center"
        if observed in ("left", "right") and side in ("left", "right") and side != observed:
            score += 80
        if best is None or score < best[2]:
            best = (m, mode, score, float(residual[0]))
    return best


def plain_court(frames):
    """(frame, points of each) of one game, in order, to what each update comes to."""
    good = last = mode = side = pending = center = None
    count = transition = streak = 0
    reseed, before, still, missing, out = False, [None] * 33, [0] * 33, [46] * 33, []
    for f, seen in frames:
        p = [seen[k][0] if k in seen and inner(seen[k][0]) else None for k in range(33)]
        conf = [seen[k][1] if k in seen else 0.0 for k in range(33)]
        slopes = []
        for line in (T.LEFT, T.CENTER, T.LEFT_INNER, T.RIGHT, T.RIGHT_INNER):
            use = sorted((p[k][1], k) for k in line if p[k] and conf[k] >= 0.1)
            for i, (y, a) in enumerate(use):
                slopes += [(p[b][0] - p[a][0]) / (z - y) for z, b in use[i + 1 :] if z - y >= 18]
        slope = median(slopes) if slopes else 0
        mids = [p[k][0] for k in T.CENTER if p[k] and conf[k] >= 0.05]
        n_left, n_right = (sum(bool(p[k]) and conf[k] >= 0.05 for k in g) for g in ((*T.LEFT, *T.LEFT_INNER), (*T.RIGHT, *T.RIGHT_INNER)))
        if slopes and abs(slope) >= 0.08:
            observed = "left" if slope < 0 else "right"
        elif mids:
            center = sum(mids) / len(mids)
            observed = "right" if center / 1280 < 0.4 else "left" if center / 1280 > 0.6 else "center"
        elif center is not None:
            observed = "right" if center / 1280 < 0.5 else "left"
        else:
            observed = "right" if n_right >= 3 and n_right >= n_left + 2 else "left" if n_left >= 3 and n_left >= n_right + 2 else None
        if observed in (None, "center", side):
            pending, count = None, 0
        elif observed == pending:
            count += 1
        else:
            pending, count = observed, 1
        switched = side is not None and pending is not None and count >= 6
        if switched:
            gone = (*T.LEFT, *T.LEFT_INNER) if side == "left" else (*T.RIGHT, *T.RIGHT_INNER)
            side, pending, count, transition, reseed = pending, None, 0, 8, True
            for k in gone:
                before[k], still[k], missing[k] = None, 0, 46
                if good:
                    good[k] = None
        both = [k for k in range(33) if good and p[k] and inner(good[k])]
        reset = bool(both) and sum(far(p[k], good[k]) > 150 for k in both) / len(both) > 0.5
        if reset:
            good, before, still, missing = None, [None] * 33, [0] * 33, [46] * 33
        for k in range(33):
            if not p[k]:
                still[k], before[k] = 0, None
                continue
            band = p[k][0] <= 384 or p[k][0] >= 896 or p[k][1] <= 216 or p[k][1] >= 504
            still[k] = still[k] + 1 if band and before[k] and far(p[k], before[k]) <= 6 else 0
            before[k] = p[k]
            if still[k] >= 45:
                p[k], conf[k] = None, 0.0
        first = choose([q if q and c >= 0.1 else None for q, c in zip(p, conf)], observed, f, None, None, False, False)
        if first:
            for k in range(33):
                tx, ty = T.TEMPLATE[k][1:3]
                if p[k] and far(image(first[0], p[k]), (tx if first[1] == "normal" else 300 - tx, ty)) > 50:
                    p[k] = None
        carried = 0
        for k in range(33):
            missing[k] = 0 if p[k] else missing[k] + 1
            if good and inner(good[k]):
                if p[k]:
                    p[k] = (0.6 * p[k][0] + 0.4 * good[k][0], 0.6 * p[k][1] + 0.4 * good[k][1])
                elif missing[k] <= 45:
                    p[k], carried = good[k], carried + 1
        p = [q if inner(q) else None for q in p]
        n = sum(q is not None for q in p)
        best = choose(p, observed, f, last, mode, reseed, True)
        ok = False
        if best:
            shifts = [far(image(best[0], q), image(last, q)) for q in ((x, y) for y in (0, 360, 719) for x in (0, 640, 1279))] if last else []
            if last is None:
                ok = n >= 6
            elif n < 6:
                ok = False
            elif reseed:
                ok = n >= 7 and best[3] <= 14
            elif n >= 7 and best[3] <= 8 or streak >= 2 and best[3] <= 14:
                ok = True
            elif transition > 0:
                ok = n >= 7 and sum(shifts) / 9 <= 17.5 and max(shifts) <= 40
            else:
                ok = sum(shifts) / 9 <= 35 and max(shifts) <= 80
        if ok:
            last, mode, good, reseed, status, streak = best[0], best[1], list(p), False, "ok", 0
            side = observed if observed in ("left", "right") else side
        else:
            status, streak = "fallback" if last else "fail", streak + 1
            p = list(good) if last and good else p
        transition = max(0, transition - 1)
        out.append((f, status, mode, observed, side, switched, reset, streak, n, carried, [tuple(map(lambda v: round(v, 4), q)) if q else (0.0, 0.0) for q in p]))
    return out


def test_court_run(spark):
    """Over the games of the views: all outcomes, both modes, switches, jumps, still points, fallbacks and cold starts."""
    rows = tables.views(spark, MIDDLE).orderBy("frame_idx", "kp_idx").collect()
    games = {}
    for r in rows:
        games.setdefault(r.game_id, {}).setdefault(r.frame_idx, {})[r.kp_idx] = (None if r.x is None else (float(r.x), float(r.y)), r.conf)
    got = {}
    for r in court_state.court_run(tables.views(spark, MIDDLE)).orderBy("frame_idx").collect():
        told = (r.frame_idx, r.status, r.mode, r.observed, r.court_side, r.switched, r.reset, r.streak, r.n_valid, r.n_carried, [(round(x, 4), round(y, 4)) for x, y in zip(r.xs, r.ys)])
        got.setdefault(r.game_id, []).append(told)
    assert len(got) == 3
    for game, frames in games.items():
        for a, b in zip(got[game], plain_court(sorted(frames.items()))):
            assert a[:10] == b[:10], (a[:10], b[:10])
            assert all(far(p, q) < 0.01 for p, q in zip(a[10], b[10]))
    all_rows = [r for g in got.values() for r in g]
    assert {r[1] for r in all_rows} >= {"ok", "fallback"} and any(r[6] for r in all_rows) and any(r[9] for r in all_rows)


def crowd_of(games=2, frames=60, seed=5):
    draw, rows = random.Random(seed), []
    for g in range(games):
        for f in range(frames):
            for k in range(9):
                if draw.random() < 0.2 or 25 < f < 29:
                    continue
                x, y = 60 * (k % 5) + 3 * (f % 20) + draw.randrange(12), 100 + 20 * (k % 3) + draw.randrange(9)
                rows.append((g, 1000 * g + f, 100 * (1000 * g + f) + k, x, y, x + 60 + k, y + 150, 8 if k == 8 else 3, draw.choice((0.2, 0.55, 0.75, 0.9))))
    return rows


SCHEMA = "game_id int, frame_idx long, det_id long, x1 long, y1 long, x2 long, y2 long, class_id int, confidence double"


FORWARD = np.array([[float(i == j or j == i + 4) for j in range(8)] for i in range(8)])


def see(d):
    w, h = d["x2"] - d["x1"], d["y2"] - d["y1"]
    return np.array([d["x1"] + w / 2, d["y1"] + h / 2, w / h, h])


def best_pairs(cost, limit):
    """The best set of pairs within the limit, by trying all, row by row."""

    def rest(i, used):
        if i == len(cost):
            return 0.0, []
        options = [rest(i + 1, used)]
        for j, c in enumerate(cost[i]):
            if c <= limit and j not in used:
                gain, pairs = rest(i + 1, used | {j})
                options.append((gain + limit - c, [(i, j), *pairs]))
        return max(options, key=lambda o: o[0])

    return rest(0, frozenset())[1]


def plain_tracks(rows):
    """One game's detections to shown tracks (frame, is_referee, track, det), step by step."""
    known, born, fresh, out, last = {False: [], True: []}, {}, {False: 1, True: 1}, [], None
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r[1], []).append(dict(zip(("game", "frame", "det", "x1", "y1", "x2", "y2", "cls", "conf"), r)))
    age = lambda f, role, t: max(0, f - born.get((role, t), f))
    for f in sorted(by_frame):
        known = {role: [t for t in some if f - t["seen"] <= 121] for role, some in known.items()}
        for d in by_frame[f]:
            d["ref"], d["c"] = d["cls"] == 8, []
            for t in known[d["ref"]]:
                v, q, active = iou(d, t), dist(d, t), t["seen"] == f - 1
                if v >= 0.3 if active else v >= 0.2 or q <= 160:
                    d["c"].append((v + 0.25 * active - min(q, 500) / 5000, active, t["id"]))
            d["c"].sort(key=lambda c: (-c[0], not c[1], c[2]))
            d["age"] = age(f, d["ref"], d["c"][0][2]) if d["c"] else 0

        def parted(a, b):
            best = None
            for s, _, i in a["c"]:
                for t, _, j in b["c"]:
                    if i != j and (best is None or s + t > best[0]):
                        best = (s + t, age(f, a["ref"], i), age(f, a["ref"], j))
            return best is not None and not (best[1] <= 5 and best[2] >= 8 or best[2] <= 5 and best[1] >= 8)

        kept = []
        for d in sorted(by_frame[f], key=lambda d: (-min(d["age"], 60), -d["conf"], d["det"])):
            if not any(iou(d, k) >= 0.8 if d["ref"] != k["ref"] else iou(d, k) >= 0.65 and not parted(d, k) for k in kept):
                kept.append(d)
        for role in (False, True):
            mine = sorted((d for d in kept if d["ref"] == role), key=lambda d: d["det"])
            for t in known[role]:
                for n in range(f - last):
                    m, p = t["state"]
                    if n or t["seen"] < last:
                        m[7] = 0
                    h = m[3]
                    q = np.diag([(h / 20) ** 2, (h / 20) ** 2, 1e-4, (h / 20) ** 2, (h / 160) ** 2, (h / 160) ** 2, 1e-10, (h / 160) ** 2])
                    t["state"] = (FORWARD @ m, FORWARD @ p @ FORWARD.T + q)
            taken, sure, weak = {}, [d for d in mine if d["conf"] >= 0.5], [d for d in mine if 0.1 <= d["conf"] < 0.5]

            def go(tracks, dets, limit, fused):
                box = lambda t: dict(zip(("x1", "y1", "x2", "y2"), (lambda m: (m[0] - m[2] * m[3] / 2, m[1] - m[3] / 2, m[0] + m[2] * m[3] / 2, m[1] + m[3] / 2))(t["state"][0])))
                cost = [[1 - iou(box(t), d) * (d["conf"] if fused else 1) for d in dets] for t in tracks]
                for i, j in best_pairs(cost, limit):
                    taken[dets[j]["det"]] = tracks[i]

            go([t for t in known[role] if t["ok"]], sure, 0.8, True)
            go([t for t in known[role] if t["ok"] and t["seen"] == last and not any(t is u for u in taken.values())], weak, 0.5, False)
            go([t for t in known[role] if not t["ok"]], [d for d in sure if d["det"] not in taken], 0.7, True)
            known[role] = [t for t in known[role] if t["ok"] or any(t is u for u in taken.values())]
            for d in mine:
                if t := taken.get(d["det"]):
                    m, p = t["state"]
                    h, z = m[3], see(d)
                    s = p[:4, :4] + np.diag([(h / 20) ** 2, (h / 20) ** 2, 1e-2, (h / 20) ** 2])
                    k = p[:, :4] @ np.linalg.inv(s)
                    t.update(state=(m + k @ (z - m[:4]), p - k @ s @ k.T), seen=f, ok=True, **{c: d[c] for c in ("x1", "y1", "x2", "y2")})
                elif d["conf"] >= 0.7:
                    z = see(d)
                    h = z[3]
                    p = np.diag([(h / 10) ** 2, (h / 10) ** 2, 1e-4, (h / 10) ** 2, (h / 16) ** 2, (h / 16) ** 2, 1e-10, (h / 16) ** 2])
                    known[role].append(dict(id=fresh[role], state=(np.r_[z, np.zeros(4)], p), seen=f, ok=last is None, **{c: d[c] for c in ("x1", "y1", "x2", "y2")}))
                    fresh[role] += 1
                    if last is None:
                        taken[d["det"]] = known[role][-1]
            shown = []
            for d in sorted((d for d in mine if d["det"] in taken), key=lambda d: (-min(age(f, role, taken[d["det"]]["id"]), 60), -d["conf"], taken[d["det"]]["id"])):
                young = age(f, role, taken[d["det"]]["id"]) <= 5
                near = lambda k: iou(d, k) >= 0.85 or iou(d, k) >= 0.7 and dist(d, k) <= 45
                if not (young and any(age(f, role, taken[k["det"]]["id"]) >= 8 and near(k) for k in shown)):
                    shown.append(d)
            for d in sorted(shown, key=lambda d: d["det"]):
                born.setdefault((role, taken[d["det"]]["id"]), f)
                out.append((f, role, taken[d["det"]]["id"], d["det"]))
        last = f
    return out


@pytest.mark.parametrize("seed", range(40))
def test_assignment(seed):
    """As good as the best of all sets of pairs, and within the limit; wide, high, empty and tied tables too."""
    draw = np.random.default_rng(seed)
    n, m = draw.integers(0, 6, 2)
    cost = draw.random((n, m)) if seed % 3 else draw.integers(0, 4, (n, m)) / 4
    limit = float(draw.choice([0.0, 0.25, 0.5, 0.8, 1.0]))
    got, want = assignment.assign(cost, limit), best_pairs(cost.tolist(), limit)
    gain = lambda pairs: sum(limit - cost[i, j] for i, j in pairs)
    assert gain(got) == pytest.approx(gain(want)) and all(cost[i, j] <= limit for i, j in got)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_unconfirmed(spark):
    """A track is shown from its second frame on, in a game's first frame at once; one that isn't seen again in the next frame is forgotten; a lost one comes back."""
    at = lambda f, k, x, conf=0.9: (0, f, 10 * f + k, x, 100, x + 50, 250, 3, conf)
    rows = [at(0, 0, 100), at(1, 0, 101), at(2, 0, 102), at(2, 1, 500), at(3, 0, 103), at(4, 0, 104), at(4, 1, 700), at(5, 0, 105), at(5, 1, 701), at(6, 1, 702, 0.3), at(12, 0, 106), at(13, 0, 106)]
    got = sorted((r.frame_idx, r.track_id, r.det_id) for r in association.associate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 0), (1, 1, 10), (2, 1, 20), (3, 1, 30), (4, 1, 40), (5, 1, 50), (5, 3, 51), (6, 3, 61), (12, 1, 120), (13, 1, 130)]


def test_association_whole(spark):
    rows = crowd_of()
    got = sorted((r.frame_idx, r.is_referee, r.track_id, r.det_id) for r in association.associate(spark.createDataFrame(rows, SCHEMA), whole=True).collect())
    want = sorted(x for g in (0, 1) for x in plain_tracks([r for r in rows if r[0] == g]))
    assert got == want and len(want) < len(rows)


def test_batches(spark):
    """A game's rows in many small batches give what they give in one."""
    d = spark.createDataFrame(crowd_of(3, 40, 8), SCHEMA)
    want = sorted(map(str, association.associate(d, whole=True).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, association.associate(d, whole=True).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert association.associate(d.limit(0), whole=True).collect() == []


@pytest.fixture(scope="module")
def whole(spark):
    d, r = tables.detections(spark, MIDDLE).where("game_id < 2"), tables.place_masks(spark, MIDDLE).where("game_id < 2")
    state = runs.updates(tables.views(spark, MIDDLE).where("game_id < 2")).cache()
    return d, r, state, *(x.cache() for x in runs.track_run(d, r, state))


def plain_foot(mask):
    ys, xs = np.nonzero(mask)
    low = ys >= np.percentile(ys, 88)
    if low.sum() < 4:
        low = ys >= ys.max() - 3
    return float(np.median(xs[low])), float(np.percentile(ys[low], 96))


def plain_links(rows, switches, holding):
    """Aliases frame by frame: rows (frame, id, centre) of players; `switches` of masks by frame; (id, frame) of removals with a mask. {frame: {new: source}}."""
    by, seen, before, lost, removed, out, born = {}, {}, {}, {}, {}, {}, {}
    for f, t, c in rows:
        by.setdefault(f, {})[t] = c
    for f in range(min(by), max(by) + 1):
        now = by.get(f, {})
        changed = dict(switches.get(f, []))
        expired = [t for t, (s, _) in seen.items() if f - s > C.buffer and t not in now]
        for t in set(before) - set(now) - set(expired):
            lost[t] = (f, before[t])
        fresh = [t for t in now if t not in before and (t not in seen or f - seen[t][0] > C.buffer + 1)]
        for t in now:
            lost.pop(t, None)
        for t in expired:
            lost.pop(t, None)
        for places in (lost, removed):
            for t in [t for t, (at, _) in places.items() if f - at > C.switch_dt]:
                del places[t]
        for t in fresh:
            found = sorted((math.hypot(now[t][0] - c[0], now[t][1] - c[1]), f - at, s) for places in (removed, lost) for s, (at, c) in places.items() if s != t)
            found = [x for x in found if x[0] <= C.switch_dist]
            if found and (len(found) == 1 or found[1][0] - found[0][0] >= C.switch_margin):
                changed[t] = found[0][2]
            born[t] = f
        for t in expired:
            if (t, f) not in holding and f - born[t] >= C.source_life:
                removed[t] = (f, seen[t][1])
            del seen[t]
        seen |= {t: (f, c) for t, c in now.items()}
        before = now
        if changed:
            out[f] = changed
    return out


def test_track_run(spark, whole):
    """The run of two games, from associated tracks on, by a loop over pixels and frames: masks, suppression, activation, feet, aliases, templates, projection
    and smoothing."""
    d, r, state, online, links, tracks, points = whole
    found = sorted(association.associate(d, whole=True).collect(), key=lambda r: (r.game_id, r.frame_idx, r.is_referee, r.det_id))
    masks_of, held = {}, {}
    for m in r.collect():
        masks_of.setdefault((m.game_id, m.frame_idx), []).append(m)
    for u in state.collect():
        assert u.frame_idx % 2 == 0
        held[u.game_id, u.frame_idx] = u
    target = np.array([(tx, ty) for _, tx, ty, _ in TEMPLATE], float)
    got_tracks = {(t.game_id, t.frame_idx, t.is_referee, t.track_id): t for t in tracks.collect()}
    got_points = {(p.game_id, p.frame_idx, p.track_id): p for p in points.collect()}
    sources, by_mask, wanted = {}, 0, 0
    for game in (0, 1):
        machine, active, birth, shown_rows, handed, holding, player_rows = Plain(C), set(), {}, [], {}, set(), []
        frames = sorted({t.frame_idx for t in found if t.game_id == game})
        for f in frames:
            rows = [(game, f, n, t.track_id, t.is_referee, t.x1, t.y1, t.x2, t.y2, t.confidence) for n, t in enumerate(t for t in found if t.game_id == game and t.frame_idx == f)]
            image = np.zeros((C.frame_h, C.frame_w), np.int16)
            for m in masks_of.get((game, f), []):
                image[m.y, m.x_start : m.x_end] = m.mask_id
            due = [t for t in machine.last if f - machine.last[t] > C.buffer and t not in {x[3] for x in rows if not x[4]}]
            free = machine.begin(f, rows, image)
            handed[f] = [(t, other) for t, kind, _, other, _ in machine.log if kind == "reuse"]
            holding |= {(t, f) for t in due if t in machine.mask_of}
            player_rows += [(f, t, ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)) for t, b, _ in machine.pending[1]]
            left = {t for t, _, _ in free}
            all_rows = [x for x in rows if x[4] or x[3] in left]
            boxes = {(x[4], x[3]): dict(zip(("x1", "y1", "x2", "y2"), x[5:9]), role=x[4], id=x[3], conf=x[9]) for x in all_rows}
            for k, b in boxes.items():
                birth.setdefault(k, (f, (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2))
            age = {k: f - birth[k][0] for k in boxes}

            def bars(a, b):
                v = iou(boxes[a], boxes[b])
                if a[0] != b[0]:
                    return v >= C.cross_role_iou
                young = min(age[a], age[b]) <= C.young_age and max(age[a], age[b]) >= C.old_age
                apart = abs(birth[a][0] - birth[b][0]) > C.birth_gap or math.hypot(birth[a][1] - birth[b][1], birth[a][2] - birth[b][2]) > C.birth_dist
                return v >= C.track_same_iou and (young and v >= C.track_young_iou or not apart)

            kept = []
            for n, k in sorted(enumerate(boxes), key=lambda nk: (-min(age[nk[1]], 60), -boxes[nk[1]]["conf"], nk[0])):
                if not any(bars(q, k) for q in kept):
                    kept.append(k)
            shown = [p for p in free if (False, p[0]) in kept]
            seen = machine.look(shown)
            u = held.get((game, f - f % 2))
            h = u and u.h0 is not None and [[u[f"h{3 * i + j}"] for j in range(3)] for i in range(3)]
            for t, b, _ in shown:
                if t in active:
                    continue
                share = area = 0
                if t in seen and h:
                    ys, xs = np.nonzero(seen[t])
                    step = max(1, len(xs) // 2500)
                    spots = [image_of(h, p) for p in zip(xs[::step].tolist(), ys[::step].tolist())]
                    share = sum(0 <= x < 300 and 0 <= y < 161 for x, y in spots) / len(spots)
                    area = round(len(xs) * share)
                if area == 0 and (not h or u.streak >= 3):
                    continue
                w, high = b[2] - b[0], b[3] - b[1]
                spots = [(b[0] + w * a, b[3]) for a in (0.5, 0.25, 0.75)] + [(b[0] + w / 2, b[1] + high * c) for c in (0.8, 0.65)]
                if h and sum(0 <= x < 300 and 0 <= y < 161 for x, y in (image_of(h, s) for s in spots)) >= 2 or share >= 0.12:
                    active.add(t)
            for _ in range(2):
                seen = machine.look([p for p in shown if p[0] in active])
            machine.end()
            for role, t in kept:
                if role or t in active:
                    b = boxes[role, t]
                    foot = plain_foot(seen[t]) if t in seen and not role else ((b["x1"] + b["x2"]) / 2, max(b["y1"], b["y2"] - 3))
                    shown_rows.append((f, role, t, foot, None if role else machine.mask_of.get(t), t in seen))
                    by_mask += t in seen and not role
        assert {k for k in got_tracks if k[0] == game} == {(game, f, role, t) for f, role, t, *_ in shown_rows}
        aliases, now, last, last_seen = plain_links(player_rows, handed, holding), {}, {}, {}
        for f in frames:
            now |= aliases.get(f, {})
            u = held.get((game, f - f % 2))
            h = u and u.h0 is not None and [[u[f"h{3 * i + j}"] for j in range(3)] for i in range(3)]
            xy = np.array([u.xs, u.ys]).T if u else np.zeros((33, 2))
            there = (xy > 0).all(1)
            image = target.copy()
            if there.any():
                mean, want = target[there, 0].mean(), u.layout or u.court_side
                side = lambda x: "left" if x < 129 else "right" if x > 171 else "center"
                flipped = side(mean) != want and (side(300 - mean) == want or u.mode == "mirrored") if want in ("left", "right") else u.mode == "mirrored"
                if flipped:
                    image[:, 0] = 300 - image[:, 0]
            for _, role, t, foot, mask, masked in sorted((x for x in shown_rows if x[0] == f and not x[1]), key=lambda x: x[2]):
                g, stable = got_tracks[game, f, False, t], now.get(t, t)
                assert (g.stable_id, g.mask_id, g.by_mask) == (stable, mask, masked) and (g.fx, g.fy) == pytest.approx(foot)
                rel = None
                if there.sum() >= 2:
                    near = sorted(np.flatnonzero(there).tolist(), key=lambda k: (math.dist(xy[k], foot), k))[:6]
                    weight = [(math.dist(xy[k], foot) + 1) ** -1.35 * min(1, max(0.25, u.confs[k])) for k in near]
                    rel = [min(max(sum(w * image[k][c] for w, k in zip(weight, near)) / sum(weight), 0), (299, 160)[c]) for c in (0, 1)]
                p, source = None, None
                if h:
                    raw = image_of(h, foot)
                    inside = -25 <= raw[0] <= 325 and -25 <= raw[1] <= 186
                    hp = [min(max(raw[0], 0), 299), min(max(raw[1], 0), 160)]
                    p, source = (hp, "H") if inside else (None, None) if rel is None else ([0.15 * a + 0.85 * b for a, b in zip(hp, rel)], "relative-guard")
                elif rel:
                    p, source = rel, "relative"
                if p is None or last_seen.get(stable) == f:
                    continue
                if stable in last and f - last_seen[stable] <= 12:
                    dx, dy = p[0] - last[stable][0], p[1] - last[stable][1]
                    size = math.hypot(dx, dy)
                    cut = 18 / size if size > 18 else 1
                    p = [0.45 * a + 0.55 * (a + v * cut) for a, v in zip(last[stable], (dx, dy))]
                last[stable], last_seen[stable] = p, f
                mine = got_points[game, f, stable]
                assert mine.source == source and (mine.sx, mine.sy) == pytest.approx(p, abs=1e-6)
                sources[source] = sources.get(source, 0) + 1
                wanted += 1
    assert wanted == len(got_points) and by_mask > 200 and sources["H"] > 1000
    assert any(t.stable_id != t.track_id for t in got_tracks.values()) and links.where("source_kind = 'mask'").count() > 0


def test_games_run_apart(spark, whole):
    """A game's positions don't depend on the games beside it, and steps are bounded as smoothing says."""
    d, r, state, *_, points = whole
    alone = runs.track_run(*(t.where("game_id = 1") for t in (d, r, state)))[-1]
    rows = lambda f: sorted((r.frame_idx, r.track_id, round(r.sx, 6), round(r.sy, 6)) for r in f.collect())
    assert rows(alone) == rows(points.where("game_id = 1"))
    last = {}
    for r in points.orderBy("frame_idx").collect():
        k = (r.game_id, r.track_id, r.stay)
        if k in last:
            assert math.hypot(r.sx - last[k].sx, r.sy - last[k].sy) <= C.max_step * (1 - C.smooth_prev) + 1e-9
        last[k] = r
    assert tactical.KEY


def test_run_edges(spark):
    """Games without masks, without a court, and without anything."""
    d, r, v = (t.where("game_id = 0 AND frame_idx < 60") for t in (tables.detections(spark, MIDDLE), tables.place_masks(spark, MIDDLE), tables.views(spark, MIDDLE)))
    state = runs.updates(v)
    none = lambda t: t.limit(0)
    online, _, tracks, points = runs.track_run(d, none(r), state)
    assert points.count() > 0 and online.where("by_mask").count() == 0
    online, _, tracks, points = runs.track_run(d, r, none(state))
    assert points.count() == 0 and tracks.where("NOT is_referee").count() == 0 < tracks.count()
    assert [x.count() for x in runs.track_run(none(d), r, state)] == [0, 0, 0, 0]


def test_jersey_run(spark):
    """Reads in number boxes of every third frame vote for the first player that holds them, by its stable id."""
    tracks = [(0, f, False, t, s, n, 100 * t, 0, 100 * t + 150, 100, 0.9) for f in range(12) for n, (t, s) in enumerate([(2, 1), (1, 1), (3, 3)] if f < 9 else [(3, 3)])]
    tracks = spark.createDataFrame(tracks, "game_id int, frame_idx long, is_referee boolean, track_id long, stable_id long, place int, x1 long, y1 long, x2 long, y2 long, confidence double")
    boxes = [(0, f, 10 * f + k, x, 10, x + 20, 30, 2, 0.8) for f in range(12) for k, x in enumerate((210, 330))]
    boxes = spark.createDataFrame(boxes, "game_id int, frame_idx long, det_id long, x1 long, y1 long, x2 long, y2 long, class_id int, confidence double")
    reads = [(0, f, 10 * f + k, text, 0.9) for f in range(12) for k, text in enumerate(("2B", "l7"))]
    reads = spark.createDataFrame(reads, "game_id int, frame_idx long, det_id long, text string, conf double")
    voted = runs.jersey_run(boxes, reads, tracks)
    # Tracks 2 and 1 show as 1, with the box of the later one, which ends at 250; 17 is read in the box of 3 in frames 0, 3, 6 and 9.
    assert sorted((r.track_id, r.number, r.frame_idx) for r in voted.collect()) == [(1, "28", f) for f in (0, 3, 6)] + [(3, "17", f) for f in (0, 3, 6, 9)]
    assert sorted((r.track_id, r.jersey, r.lock_frame) for r in runs.jersey.locks(voted).collect()) == [(1, "28", 6), (3, "17", 6)]


def plain_lifecycle(rows, end):
    """Frame by frame over one role of one game, as a tracker tells it: rows (frame, track, centre) to counts of events and of switches."""
    by, seen = {}, {}
    for f, t, c in rows:
        by.setdefault(f, {})[t] = c
    first = min(by)
    before, lost_at, lost_place, gone_place, place_of = {}, {}, {}, {}, {}
    n = dict.fromkeys(("new", "lost", "recovered", "removed", "switches"), 0)
    removed_once = set()
    for f in range(first, end + 1):
        now = by.get(f, {})
        out = [t for t, s in seen.items() if f - s == 121 and t not in now]
        fresh = []
        for t in now:
            if t in before:
                continue
            place = lost_place.pop(t, None)
            if t in lost_at:
                gap = f - lost_at.pop(t)
                n["recovered"] += 1
                if place and far(now[t], place[1]) > 80 or not place and gap > 90:
                    n["switches"] += 1
            else:
                fresh.append(t)
                n["new"] += 1
        for t in before:
            if t not in now and t not in out:
                lost_at[t], lost_place[t] = f, (f, before[t])
                n["lost"] += 1
        here = {}
        for t in out:
            lost_at.pop(t, None)
            lost_place.pop(t, None)
            here[t] = (f, place_of[t])
            n["removed"] += t not in removed_once
            removed_once.add(t)
            del seen[t]
        for places in (lost_place, gone_place):
            for t in [t for t, (at, _) in places.items() if f - at > 60]:
                del places[t]
        for t in fresh:
            found = sorted((far(now[t], c), f - at) for some in (gone_place, lost_place) for s, (at, c) in some.items() if s != t and far(now[t], c) <= 80)
            if found and (len(found) == 1 or found[1][0] - found[0][0] >= 20):
                n["switches"] += 1
        gone_place |= here
        seen |= dict.fromkeys(now, f)
        place_of |= now
        before = now
    return n


def test_lifecycle_of_a_run(spark):
    """Totals and switches of associated tracks, and of the wide-ranging ones of the tables, against the loop."""
    from pyspark.sql import functions as F

    from trackweave.operators import lifecycle

    shown = association.associate(spark.createDataFrame(crowd_of(2, 200, 11), SCHEMA), whole=True)
    for t in (shown, tables.tracks(spark, MIDDLE).where("game_id < 2")):
        rows = t.select("game_id", "is_referee", "frame_idx", "track_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")).collect()
        got = {(r.game_id, r.is_referee): {k: r[f"n_{k}"] for k in ("new", "lost", "recovered", "removed", "switches")} for r in lifecycle.summary(lifecycle.edges(t), lifecycle.switches(t)).collect()}
        for game, role in got:
            end = max(r.frame_idx for r in rows if r.game_id == game)
            want = plain_lifecycle([(r.frame_idx, r.track_id, (r.x, r.y)) for r in rows if (r.game_id, r.is_referee) == (game, role)], end)
            assert got[game, role] == want, (game, role, got[game, role], want)
