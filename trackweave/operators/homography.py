"""Homographies from keypoint pairs: direct linear transform with seeded RANSAC, of many frames at once.

No SQL form exists, so it runs in Arrow-batched pandas: frames are grouped in coarse buckets, for a group costs more than its work, and a
bucket's frames are one set of arrays. The results agree with those of other RANSACs by tolerance only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config

H = [f"h{k}" for k in range(9)]
BUCKET, TRIES = 256, 64


def normalizer(p: np.ndarray, use: np.ndarray) -> np.ndarray:
    """For each frame the similarity that moves its used points to the origin, at a mean distance of sqrt(2)."""
    n = np.maximum(1, use.sum(1))
    c = (p * use[..., None]).sum(1) / n[:, None]
    far = np.sqrt((((p - c[:, None]) ** 2).sum(2) * use).sum(1) / n)
    s = np.sqrt(2) / np.maximum(far, 1e-9)
    out = np.zeros((len(p), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = s
    out[:, 0, 2], out[:, 1, 2], out[:, 2, 2] = -s * c[:, 0], -s * c[:, 1], 1
    return out


def equations(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Two rows of the linear system for each pair of points (arrays of shape ..., n, 2), of shape ..., 2 n, 9."""
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    upper = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1)
    lower = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=-1)
    return np.concatenate([upper, lower], axis=-2)


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Images of points (..., n, 2) under homographies (..., 3, 3)."""
    q = np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1) @ np.swapaxes(h, -1, -2)
    w = np.where(np.abs(q[..., 2:]) < 1e-12, 1e-12, q[..., 2:])
    return q[..., :2] / w


def normalized(p: np.ndarray, q: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalizers of both sides of the pairs, and the points under them: both sides at once, for a small array costs more than its numbers."""
    n, both = len(p), np.concatenate([p, q])
    m = normalizer(both, np.concatenate([use, use]))
    moved = apply(m, both)
    return m[:n], m[n:], moved[:n], moved[n:]


def least_squares(p: np.ndarray, q: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The homography of least squares of each frame's used, normalized points."""
    a, b, p, q = normalized(p, q, use)
    rows = equations(p, q) * np.concatenate([use, use], axis=1)[..., None]
    _, vectors = np.linalg.eigh(np.swapaxes(rows, 1, 2) @ rows)
    return np.linalg.inv(b) @ vectors[:, :, 0].reshape(-1, 3, 3) @ a


def draws_of(seeds: np.ndarray, points: int, tries: int = TRIES) -> np.ndarray:
    """The random numbers by which each frame draws its fours."""
    return np.stack([np.random.default_rng(int(s)).random((tries, points)) for s in seeds])


def medians(values: np.ndarray) -> np.ndarray:
    """The median of each row's entries that aren't NaN; NaN without any."""
    v = np.sort(values, axis=1)
    n, at = (~np.isnan(v)).sum(1), np.arange(len(v))
    return (v[at, np.maximum(n - 1, 0) // 2] + v[at, np.minimum(n // 2, v.shape[1] - 1)]) / 2


def of_fours(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The homography through each set of four pairs (arrays of shape ..., 4, 2) whose last entry is 1; nonsense for degenerate sets."""
    rows = equations(p, q)
    a, b = rows[..., :8], -rows[..., 8:]
    turned = np.swapaxes(a, -1, -2)
    solved = np.linalg.solve(turned @ a + 1e-9 * np.eye(8), turned @ b)
    return np.concatenate([solved[..., 0], np.ones((*solved.shape[:-2], 1))], axis=-1).reshape(*solved.shape[:-2], 3, 3)


def estimate_all(src: np.ndarray, dst: np.ndarray, use: np.ndarray, seeds: np.ndarray, cfg: Config = DEFAULT, tries: int = TRIES, draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(H, whether it passes the gates, median residual) of each frame: src and dst of shape (frames, points, 2), `use` says which pairs count.

    RANSAC takes the inliers of the best of some random fours, the same for a frame whatever its company, and fits all of them; a result
    needs four points, finite entries, a determinant away from 0 and a small median residual. `draws` are `draws_of(seeds)`, where they are at hand."""
    enough = np.flatnonzero(use.sum(1) >= 4)
    h, ok, residual = np.zeros((len(use), 3, 3)), np.zeros(len(use), bool), np.full(len(use), np.inf)
    if len(enough):
        h[enough], ok[enough], residual[enough] = _estimate(src[enough], dst[enough], use[enough], draws_of(seeds[enough], use.shape[1], tries) if draws is None else draws[enough], cfg)
    return h, ok, residual


def _estimate(src: np.ndarray, dst: np.ndarray, use: np.ndarray, draws: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frames, tries = draws.shape[:2]
    src, dst = np.where(use[..., None], src, 0.0), np.where(use[..., None], dst, 0.0)
    picks = np.argsort(draws + 2.0 * ~use[:, None, :], axis=2)[:, :, :4]
    at = np.arange(frames)[:, None, None]
    _, to, p, q = normalized(src, dst, use)
    with np.errstate(all="ignore"):
        # Normalizers keep distances up to a factor, so errors are measured under them.
        tried = of_fours(p[at, picks], q[at, picks]).reshape(frames, 3 * tries, 3)
        seen = np.ones((frames, 3, p.shape[1]))
        seen[:, :2] = np.swapaxes(p, 1, 2)
        x, y, w = np.moveaxis((tried @ seen).reshape(frames, tries, 3, -1), 2, 0)
        x, y = x / w, y / w
        x -= q[:, None, :, 0]
        y -= q[:, None, :, 1]
        x *= x
        y *= y
        x += y
        good = (x <= ((cfg.ransac_px * to[:, 0, 0]) ** 2)[:, None, None]) & use[:, None]
        best = good[np.arange(frames), good.sum(2).argmax(1)]
        h = least_squares(src, dst, best)
        h = h / np.where(np.abs(h[:, 2:, 2:]) < 1e-12, 1e-12, h[:, 2:, 2:])
        residual = medians(np.where(use, np.sqrt(((apply(h, src) - dst) ** 2).sum(-1)), np.nan))
        ok = (best.sum(1) >= 4) & np.isfinite(h).all((1, 2)) & (np.abs(np.linalg.det(h)) >= 1e-8) & (residual <= cfg.max_reproj)
    return h, ok, residual


def estimate(src: np.ndarray, dst: np.ndarray, cfg: Config = DEFAULT, seed: int = 0) -> tuple[np.ndarray, float] | None:
    """(H, median residual) of one frame's pairs; None if the gates aren't passed."""
    h, ok, residual = estimate_all(src[None], dst[None], np.ones((1, len(src)), bool), np.array([seed]), cfg)
    return (h[0], float(residual[0])) if ok[0] else None


def mirror(cfg: Config = DEFAULT) -> np.ndarray:
    """The court seen from its other side. It keeps distances, so a homography to the mirrored template is the mirrored homography."""
    return np.array([[-1.0, 0, cfg.court_w], [0, 1, 0], [0, 0, 1]])


def estimates(matched: DataFrame, cfg: Config = DEFAULT, bucket: int = BUCKET) -> DataFrame:
    """Per frame of (x, y, tx, ty) pairs: points, validity, H, its residual, and those of the mirrored template. Missing points don't count."""
    schema = "game_id int, frame_idx long, mode string, n int, ok boolean, residual double, mean_tx double, " + ", ".join(f"{h} double" for h in H)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_idx", "kp_idx"])
        ids, row = np.unique(pdf.frame_idx.to_numpy(), return_inverse=True)
        place = np.arange(len(pdf)) - np.searchsorted(row, row)
        shape = (len(ids), int(place.max()) + 1)
        src, dst, use = np.zeros((*shape, 2)), np.zeros((*shape, 2)), np.zeros(shape, bool)
        src[row, place], dst[row, place] = pdf[["x", "y"]].to_numpy(float), pdf[["tx", "ty"]].to_numpy(float)
        use[row, place] = (pdf.x > 0).to_numpy(bool) & (pdf.y > 0).to_numpy(bool)
        h, ok, residual = estimate_all(np.nan_to_num(src), dst, use, ids, cfg)
        n = use.sum(1)
        mean = np.where(n > 0, (dst[..., 0] * use).sum(1) / np.maximum(n, 1), np.nan)
        out = []
        for mode, map_, side in (("normal", np.eye(3), mean), ("mirrored", mirror(cfg), cfg.court_w - mean)):
            values = np.where(ok[:, None], (map_ @ h).reshape(-1, 9), np.nan)
            part = pd.DataFrame(values, columns=H)
            part.insert(0, "game_id", pdf.game_id.iloc[0])
            for k, (name, v) in enumerate((("frame_idx", ids), ("mode", mode), ("n", n), ("ok", ok), ("residual", np.where(ok, residual, np.nan)), ("mean_tx", side))):
                part.insert(k + 1, name, v)
            out.append(part)
        both = pd.concat(out)
        return both.astype(object).where(both.notna(), None)

    keyed = matched.select("game_id", "frame_idx", "kp_idx", "x", "y", "tx", "ty").withColumn("_b", F.floor(F.col("frame_idx") / bucket))
    parts = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "game_id", "_b").groupBy("game_id", "_b").applyInPandas(run, schema)
