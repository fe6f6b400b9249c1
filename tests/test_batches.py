"""Machines do at once, for a batch's steps, what doesn't hang on their state."""

import numpy as np

from trackweave.operators import court_state


def feed(frames: int):
    """Rows of a court that stands still, with points missing by turns, and where their frames begin."""
    f, k = (a.ravel() for a in np.meshgrid(np.arange(frames), np.arange(court_state.COUNT), indexing="ij"))
    x, y = court_state.TARGET[k].T * np.array([[4.0], [4.0]]) + 20 + np.stack([(f * 7 + k * 13) % 5, (f * 11 + k * 5) % 5])
    x = np.where((f * 5 + k * 3) % 17 == 0, np.nan, x)
    return {"frame_idx": f, "kp_idx": k, "x": x, "y": y, "conf": (f * 31 + k * 17) % 100 / 100}, list(range(0, len(f) + 1, court_state.COUNT))


def test_first_homographies_are_estimated_together(monkeypatch):
    calls, estimate = [], court_state.estimate_all
    monkeypatch.setattr(court_state, "estimate_all", lambda src, *a, **k: calls.append(len(src)) or estimate(src, *a, **k))
    rows, cuts = feed(64)
    court = court_state.Court(0)
    out = [r for f, ready in enumerate(court_state.prepared(rows, cuts)) for r in court.step(f, ready)]
    assert len(out) == 64 and {r[2] for r in out} == {"ok"}
    # Those of four batches, one of each step after smoothing, and hardly any again because of points that hang still.
    assert len(calls) <= 4 + 64 + 20 and calls[:4] == [court_state.CHUNK] * 4


def test_a_batch_gives_what_its_parts_give():
    rows, cuts = feed(40)
    run = lambda parts: [r for part, ends in parts for r in court_state.prepared(part, ends)]
    one = run([(rows, cuts)])
    each = run([({c: v[a:b] for c, v in rows.items()}, [0, b - a]) for a, b in zip(cuts[:-1], cuts[1:])])
    for a, b in zip(one, each):
        assert a.line_side == b.line_side and all(np.array_equal(x, y, equal_nan=True) for x, y in zip((a.xy, a.conf, a.draws, *a.first), (b.xy, b.conf, b.draws, *b.first)))
