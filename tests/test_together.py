"""Machines do at once what several games' steps, or a step's boxes, ask for, with the results of each alone."""

import numpy as np
from test_batches import feed

from trackweave.config import DEFAULT as C
from trackweave.operators import association, court_state, mask_state


def test_games_go_on_at_once(monkeypatch):
    rows, cuts = feed(60)
    shifted = lambda g: {**rows, "x": rows["x"] + 9 * g, "frame_idx": rows["frame_idx"] + g}
    alone = []
    for g in range(4):
        court = court_state.Court(g)
        alone.append([court.step(f + g, ready)[0] for f, ready in enumerate(court_state.prepared(shifted(g), cuts))])
    calls, estimate = [], court_state.estimate_all
    ready = [court_state.prepared(shifted(g), cuts) for g in range(4)]
    monkeypatch.setattr(court_state, "estimate_all", lambda src, *a, **k: calls.append(len(src)) or estimate(src, *a, **k))
    courts = [court_state.Court(g) for g in range(4)]
    both = [court_state.steps(courts, [f + g for g in range(4)], [r[f] for r in ready]) for f in range(60)]
    assert [list(rows) for rows in zip(*both)] == alone
    assert calls.count(4) >= 60 and len(calls) < 2 * 60


def test_a_task_has_games_of_any_begin_and_length(spark):
    rows, _ = feed(50)
    flat = list(zip(*(rows[c].tolist() for c in ("frame_idx", "kp_idx", "x", "y", "conf"))))
    some = [(g, f + 1000 * g, k, None if x != x else x, y, c) for g, n, gap in ((0, 50, 0), (1, 7, 0), (2, 30, 11)) for f, k, x, y, c in flat if f < n and f != gap]
    points = spark.createDataFrame(some, "game_id int, frame_idx long, kp_idx int, x double, y double, conf double")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        at_once = {(r.game_id, r.frame_idx): r for r in court_state.court_run(points).collect()}
        alone = [r for g in range(3) for r in court_state.court_run(points.where(f"game_id = {g}")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(at_once) == len(alone) == 49 + 7 + 29 - 1 and all(at_once[r.game_id, r.frame_idx] == r for r in alone)


def test_a_frame_overlaps_its_boxes_once(monkeypatch):
    calls, overlaps = [], association.overlaps
    monkeypatch.setattr(association, "overlaps", lambda a, b: calls.append(len(b)) or overlaps(a, b))
    tracker, x = association.Tracker(0, whole=True), np.array([10, 12, 200, 400])
    for f in range(12):
        rows = {"x1": x + f, "y1": x // 4 + f, "x2": x + 60 + f, "y2": x // 4 + 160 + f, "confidence": np.array([0.9, 0.8, 0.9, 0.75]), "is_referee": np.array([False, False, False, True]), "det_id": np.arange(4) + 10 * f}
        told = tracker.step(f, rows)
    assert [t[2:5] for t in told] == [(False, 1, 110), (False, 2, 112), (True, 1, 113)] and len(calls) == 12


def test_batches_of_pictures_are_those_of_each():
    rng, frames = np.random.default_rng(4), []
    for f in range(6):
        for m in sorted(rng.choice(20, rng.integers(0, 4), replace=False).tolist()):
            start = rng.integers(0, 90, 12)
            frames.append((f, m, rng.integers(-3, 70, 12), start, start + rng.integers(1, 40, 12)))
    one = lambda y, a, b: (y + mask_state.MOVED << 2 * mask_state.BITS) | (a + mask_state.MOVED << mask_state.BITS) | (b + mask_state.MOVED)
    names = np.array(["mask"] * len(frames), object)
    runs = np.empty(len(frames), object)
    runs[:] = [one(*r[2:]) for r in frames]
    number = [r[0] for r in frames]
    cuts = [k for k in range(len(frames)) if k == 0 or number[k] != number[k - 1]] + [len(frames)]
    ready = mask_state.prepared({"_table": names, "mask_id": np.array([float(r[1]) for r in frames]), "runs": runs}, cuts, {"mask": []})
    assert len(ready) == len(cuts) - 1
    for a, b, tables in zip(cuts, cuts[1:], ready):
        plain = mask_state.Picture({"mask_id": [r[1] for r in frames[a:b]], **{c: [r[k] for r in frames[a:b]] for k, c in ((2, "ys"), (3, "starts"), (4, "ends"))}}, set(), C)
        got = mask_state.Picture(tables["mask"], set(), C)
        assert got.ids == plain.ids and np.array_equal(got.rows, plain.rows) and (got.begins, got.areas, got.around) == (plain.begins, plain.areas, plain.around)
        for box in ((0, 0, 60, 60), (20, -5, 130, 40), (200, 200, 210, 210)):
            assert got.best(box) == plain.best(box) and all(got.cut(m, box)[:2] == plain.cut(m, box)[:2] for m in plain.ids)


def test_cuts_know_masks_within_the_box(monkeypatch):
    p = mask_state.Picture({"mask_id": np.array([7]), "ys": [np.arange(100, 140)], "starts": [np.full(40, 10)], "ends": [np.full(40, 40)]}, set())
    monkeypatch.setattr(mask_state.Picture, "within", None)
    assert p.cut(7, (5, 95, 50, 155))[:2] == (1200, 1.0)
