"""Where boxes will be: Kalman states of constant velocity, of many boxes at once.

A state is centre, aspect (width by height) and height, and their speeds. Noise grows with the height: the published two-stage trackers' weights.
No noise couples two of the four, so what is not certain of each is the variance of its place, that of its speed, and the covariance of these two. A
state is a row of 20 numbers, in fives of four: places, speeds, variances of places, covariances, variances of speeds."""

from __future__ import annotations

import numpy as np

#: Standard deviations, in heights, of positions and speeds, and those of the aspect, as such.
POSITION, SPEED = 1 / 20, 1 / 160
ASPECT_BEGIN, ASPECT_STEP, ASPECT_SPEED, ASPECT_SEEN = 1e-2, 1e-2, 1e-5, 1e-1
WIDTH = 20
#: What a standard deviation of each of the four has for each height.
_HIGH = np.array([1.0, 1.0, 0.0, 1.0])


def measured(boxes: np.ndarray) -> np.ndarray:
    """Corners as centre, aspect, height."""
    size = boxes[:, 2:] - boxes[:, :2]
    out = np.empty((len(boxes), 4))
    out[:, :2] = boxes[:, :2] + size / 2
    out[:, 2], out[:, 3] = size[:, 0] / np.maximum(size[:, 1], 1e-9), size[:, 1]
    return out


def corners(state: np.ndarray) -> np.ndarray:
    half = np.empty((len(state), 2))
    half[:, 0], half[:, 1] = state[:, 2] * state[:, 3] / 2, state[:, 3] / 2
    return np.concatenate([state[:, :2] - half, state[:, :2] + half], axis=1)


def variance(high: np.ndarray, place: float, aspect: float) -> np.ndarray:
    """Variances of the four, from standard deviations; heights come as a column."""
    std = high * place * _HIGH
    std[:, 2] = aspect
    return std * std


def begin(boxes: np.ndarray) -> np.ndarray:
    """States of boxes seen for the first time."""
    out = np.zeros((len(boxes), WIDTH))
    out[:, :4] = measured(boxes)
    out[:, 8:12], out[:, 16:] = variance(out[:, 3:4], 2 * POSITION, ASPECT_BEGIN), variance(out[:, 3:4], 10 * SPEED, ASPECT_SPEED)
    return out


def ahead(state: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """States one frame on. The height of a lost box stands still."""
    out = state.copy()
    out[lost, 7] = 0.0
    high = state[:, 3:4]
    joint = out[:, 12:16] + out[:, 16:]
    out[:, 8:12] = out[:, 8:12] + out[:, 12:16] + joint + variance(high, POSITION, ASPECT_STEP)
    out[:, 12:16] = joint
    out[:, 16:] += variance(high, SPEED, ASPECT_SPEED)
    out[:, :4] += out[:, 4:8]
    return out


def corrected(state: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """States after their boxes have been seen."""
    place, both = state[:, 8:12], state[:, 12:16]
    seen = place + variance(state[:, 3:4], POSITION, ASPECT_SEEN)
    gain, turn, off = place / seen, both / seen, measured(boxes) - state[:, :4]
    return state + np.concatenate([gain * off, turn * off, -gain * place, -gain * both, -turn * both], axis=1)
