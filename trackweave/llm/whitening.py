"""Embedding whitening by a tiled covariance.

1. Entries become integers (floor of 256 times the entry); the fit list has each distinct vector once, written to the shared folder.
2. Its size and its sums by dimension are exact integers, summed in tasks and then by dimension.
3. Dimensions are cut into column blocks of `TILE`, so that a pair of column blocks is the key of one tile of the covariance. Rows of the fit list
   are cut into row-blocks of about `BLOCK_BYTES`; a row-block's centred column blocks are shuffled by row-block, so those of one meet in one task,
   which multiplies each pair of them. A task sums its tiles as far as `HELD_BYTES` reach, then they are summed by tile key.
4. The driver gets the tiles (dimensions squared, whatever the number of rows), assembles the matrix and takes its eigenvectors.
5. Every row is projected, and the covariance of the projected fit list is held against the identity.

Defined results: null vectors and vectors with a null, NaN or infinite entry give no rows; shorter vectors count as filled up with zeros
to the longest; vectors without entries have no components, so no rows unless others have entries; a component whose eigenvalue is 0
(to rounding) has a null `whitened`, and a null `explained` where all are; `identity_error` is over the other components and null without any;
`deviation` is null where it exceeds a long; repeated rows and repeated ids give rows each; an empty table gives none; other columns are
not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import bounded_batches, discard, map_batches, materialize, runs_of

SCALE, COMPONENTS, TILE = 256, 4, 32
BLOCK_BYTES, HELD_BYTES = 2 << 20, 64 << 20


def whole(entries: Column) -> Column:
    """The entries as integers. What lies beyond a long counts as its bound."""
    return F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE))


def usable(entries: Column) -> Column:
    """Whether there is a vector and all of its entries are finite numbers."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return entries.isNotNull() & ~F.exists(entries, odd)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as one array of integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension, exact."""

    def part(batch: pa.RecordBatch) -> dict:
        rows = matrix(batch.column(0), dims)
        # Two halves of each entry, so that sums of a batch can't overflow.
        high, low = (rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0)
        return {"dim": np.arange(dims), "rows": np.full(dims, len(rows)), "high": high, "low": low}

    whole_sum = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = map_batches(fit, "dim int, rows long, high long, low long", part).groupBy("dim").agg(F.sum("rows").alias("rows"), whole_sum("high"), whole_sum("low")).collect()
    by_dim = {r.dim: (int(r.high) << 32) + int(r.low) for r in got}
    return int(got[0].rows) if got else 0, [by_dim[k] for k in range(dims)] if got else []


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the fit list: column blocks by row-block, tiles by pair of column blocks."""
    dims, mean = len(total), np.array([s / n for s in total])
    step = max(1, BLOCK_BYTES // (8 * dims))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = matrix(batch.slice(at, step).column(0), dims) - mean
                names = list(range(0, dims, TILE))
                blocks = [np.ascontiguousarray(rows[:, c : c + TILE]).tobytes() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number] * len(names)), pa.array([c // TILE for c in names], pa.int32()), pa.array(blocks)], ["row_block", "column_block", "entries"])
                number += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for run in runs_of(batches, 1):
            of_block: dict[int, list[tuple[int, np.ndarray]]] = {}
            for block, column, raw in zip(*(c.to_pylist() for c in run.columns)):
                of_block.setdefault(block, []).append((column, np.frombuffer(raw).reshape(-1, min(TILE, dims - column * TILE))))
            for blocks in of_block.values():
                for i, left in blocks:
                    for j, right in blocks:
                        if i <= j:
                            tile = left.T @ right
                            held[i, j] = held[i, j] + tile if (i, j) in held else tile
                            if len(held) * TILE * TILE * 8 > HELD_BYTES:
                                yield told(held)
                                held = {}
        if held:
            yield told(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, np.zeros(0)
        for batch in batches:
            for i, j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and key != (i, j):
                    yield told({key: tile})
                tile = np.frombuffer(raw) + (tile if key == (i, j) else 0)
                key = i, j
        if key is not None:
            yield told({key: tile})

    bounded_batches(fit.sparkSession)
    blocks = fit.mapInArrow(cut, "row_block long, column_block int, entries binary").repartition("row_block").sortWithinPartitions("row_block")
    tiles = blocks.mapInArrow(multiply, "i int, j int, entries binary").repartition("i", "j").sortWithinPartitions("i", "j")
    out = np.zeros((dims, dims))
    for i, j, raw in tiles.mapInArrow(add, "i int, j int, entries binary").toLocalIterator():
        a, b = i * TILE, j * TILE
        tile = np.frombuffer(bytes(raw)).reshape(min(TILE, dims - a), -1) / n
        out[a : a + tile.shape[0], b : b + tile.shape[1]] = tile
        out[b : b + tile.shape[1], a : a + tile.shape[0]] = tile.T
    return out


def told(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in tiles], pa.int32()), pa.array([k[1] for k in tiles], pa.int32()), pa.array([t.tobytes() for t in tiles.values()])], ["i", "j", "entries"])


def identity_error(fit: DataFrame, n: int, mean: np.ndarray, onto: np.ndarray) -> float | None:
    """Largest entry of the projected fit list's covariance minus the identity; its mean is 0 by the subtraction of the fit list's own."""
    k = onto.shape[1]
    if not k:
        return None

    def part(batch: pa.RecordBatch) -> dict:
        white = (matrix(batch.column(0), len(mean)) - mean) @ onto
        return {"at": np.arange(k * k), "entry": (white.T @ white).ravel()}

    got = map_batches(fit, "at int, entry double", part).groupBy("at").agg(F.sum("entry").alias("entry")).collect()
    both = np.zeros(k * k)
    for r in got:
        both[r["at"]] = r.entry / n
    return float(np.abs(both.reshape(k, k) - np.eye(k)).max())


def deviations(rows: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of squares of n times the entries minus the sums, exact; None beyond a long."""
    most = max(n * max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) + max(map(abs, total), default=0), 1)
    if most * most * max(1, len(total)) < 1 << 63:
        apart = rows * n - np.array(total, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, total)) for row in rows.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    good = vectors.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = good.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    full = good.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    fit = materialize(full.distinct(), "whitening-fit")
    n, total = sums(fit, dims)
    mean = np.array([s / n for s in total])
    cov = covariance(fit, n, total)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(cov))
    solid = values > max(dims, 1) * np.finfo(float).eps * max(trace, 0.0)
    error = identity_error(fit, n, mean, axes[:, solid] / np.sqrt(values[solid]))
    discard(fit)
    explained = [float(e / trace) if s else (0.0 if trace > 0 else None) for e, s in zip(values, solid)]
    onto = axes / np.sqrt(np.where(solid, values, 1))
    k = len(values)

    def project(batch: pa.RecordBatch) -> dict:
        rows = matrix(batch.column(1), dims)
        white = (rows - mean) @ onto
        count = len(rows)
        none = ~np.broadcast_to(solid, white.shape).ravel()
        return {
            "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(count), k))), "component": np.tile(np.arange(1, k + 1), count), "n": np.full(count * k, n),
            "deviation": [d for d in deviations(rows, n, total) for _ in range(k)], "whitened": pa.array(white.ravel(), mask=none),
            "explained": explained * count, "identity_error": [error] * (count * k),
        }

    return map_batches(good, schema, project, 1 << 20)
