"""Pictures look a box up once; feet are those of all pixels' percentiles."""

import numpy as np

from trackweave.operators import game, mask_state


def picture():
    y = [np.arange(100, 140), np.arange(120, 150)]
    return mask_state.Picture({"mask_id": np.array([7, 3]), "ys": y, "starts": [np.full(40, 10), np.full(30, 15)], "ends": [np.full(40, 40), np.full(30, 60)]}, set())


def test_a_box_is_looked_up_once(monkeypatch):
    calls, within = [], mask_state.Picture.within
    monkeypatch.setattr(mask_state.Picture, "within", lambda self, box, rows: calls.append(box) or within(self, box, rows))
    p, box = picture(), (5, 95, 50, 155)
    first, cut = p.best(box), p.cut(7, box)
    n = len(calls)
    assert first[0] == 7 and p.best(box) == first and p.cut(7, box) is cut and len(calls) == n
    p.clear(7)
    assert p.best(box)[0] == 3 and p.cut(7, box)[:2] == (0, 0.0) and len(calls) > n
    p.clear(3)
    assert p.best(box) == (None, 0.0)


def test_an_empty_mask_is_no_mask():
    none = np.zeros(0, np.int64)
    p = mask_state.Picture({"mask_id": np.array([2, 9]), "ys": [none, np.arange(100, 140)], "starts": [none, np.full(40, 10)], "ends": [none, np.full(40, 40)]}, set())
    assert p.best((5, 95, 50, 155))[0] == 9 and p.cut(2, (5, 95, 50, 155))[0] == 0


def test_feet_take_percentiles_of_sorted_pixels(monkeypatch):
    rng, want, percentile = np.random.default_rng(3), [], np.percentile
    some = []
    for n in rng.integers(1, 60, 200):
        start = rng.integers(0, 50, n)
        some.append(np.stack([rng.integers(0, 300, n), start, start + rng.integers(1, 12, n)], axis=1))
        p = game.pixels(some[-1])
        low = p[:, 1] >= percentile(p[:, 1], 88)
        if low.sum() < 4:
            low = p[:, 1] >= max(p[:, 1].max() - 3.0, 0.0)
        want.append((float(np.median(p[low, 0])), float(percentile(p[low, 1], 96))))
    monkeypatch.setattr(np, "percentile", None)
    assert [game.mask_foot(r) for r in some] == want
