"""Quality classifier: Naive Bayes support vectors.

Indicators of byte trigrams and of runs of one and two words are hashed to 2**20 features and scaled by the classes' log-count
ratios; a linear model with hinge loss is fitted to them by dual coordinate descent, and its margin becomes a probability by a
logistic curve fitted on labelled rows that the model hasn't seen, weighted to the labels' own class shares.

The fit uses a bounded sample of labelled rows: of each class those of the smallest hash, `PER_CLASS` rows and `CLASS_BYTES` bytes of
indicators at most, for these come to the driver. Every text is scored whole.

Defined results: null and empty texts have no indicators and get the score of the bias alone; labels other than 0 and 1 are ignored; a
doc_id with both labels counts as 0; without rows of both classes the score is the smoothed share of label 1; repeated
rows are scored alike; only doc_id, text and the labels are read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import discard, map_batches, materialize
from trackweave.llm.hashing import grams, word_hashes

BITS, PER_CLASS, CLASS_BYTES, SMOOTH, COST, EPOCHS = 20, 4000, 64 << 20, 1.0, 1.0, 12


def indicators(texts: list[str | None]) -> list[np.ndarray]:
    """The features that occur in each text, each once, in order."""
    words, at = word_hashes(texts)
    top = np.uint64(64 - BITS)
    one, two = (words >> top).astype(np.int32), (grams(words, 2) >> top).astype(np.int32)
    out = []
    for k, text in enumerate(texts):
        b = np.frombuffer(b" " + text.encode() + b" ", np.uint8).astype(np.uint32) if text else np.zeros(0, np.uint32)
        three = (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        out.append(np.unique(np.concatenate([three, one[at[k] : at[k + 1]], two[at[k] : max(at[k], at[k + 1] - 1)]])))
    return out


@dataclass
class Model:
    """Weights of the indicators (ratio times coefficient), bias, and the logistic curve's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum()) / max(1.0, len(features)) ** 0.5 + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -30, 30))))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of the ratio of each indicator's smoothed share in class 1 to that in class 0."""
    shares = []
    for label in (1, 0):
        count = np.full(1 << BITS, SMOOTH)
        for x in (x for x, c in zip(rows, y) if c == label):
            count[x] += 1
        shares.append(np.log(count / count.sum()))
    return (shares[0] - shares[1]).astype(np.float32)


def coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: each step sets one row's multiplier to its optimum within 0 and its cost."""
    sign = np.where(y == 1, 1.0, -1.0)
    scale = np.array([1 / max(1.0, len(x)) ** 0.5 for x in rows])
    square = np.array([float((ratio[x].astype(np.float64) ** 2).sum()) * s * s + 1 for x, s in zip(rows, scale)])
    w, bias, alpha = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(rows))
    order, shuffle = np.arange(len(rows)), np.random.default_rng(5)
    for _ in range(EPOCHS):
        shuffle.shuffle(order)
        for i in order:
            x = rows[i]
            r = ratio[x]
            gradient = sign[i] * (float(w[x] @ r) * scale[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += np.float32(step * scale[i]) * r
                bias, alpha[i] = bias + step, new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve by Newton steps, with smoothed targets."""
    a, b = 1.0, 0.0
    t = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * margins).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
        if not (np.isfinite(a) and np.isfinite(b) and abs(a) < 50):
            return 1.0, 0.0
        if abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, shares: tuple[int, int]) -> Model:
    """rows: indicators of the sample; y: labels; shares: labelled rows of class 0 and 1 in all."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log((shares[1] + 1) / (shares[0] + 1))))
    part = np.array([np.random.default_rng(k).random() for k in range(len(rows))]) < 0.2
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part[:] = False
    seen, unseen = np.flatnonzero(~part), np.flatnonzero(part) if part.any() else np.arange(len(rows))
    train = [rows[i] for i in seen]
    ratio = ratios(train, y[seen])
    each = np.bincount(y[seen], minlength=2)
    w, bias = coordinate_descent(train, y[seen], ratio, COST * len(seen) / (2.0 * each[y[seen]]))
    model = Model(w * ratio, bias, 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in unseen])
    held = np.bincount(y[unseen], minlength=2)
    model.slope, model.shift = logistic(margins, y[unseen], np.array(shares)[y[unseen]] / held[y[unseen]] / sum(shares) * len(unseen))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """Fit on the bounded sample of each class among the labelled rows whose crc32(doc_id) mod 3 isn't 1."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = F.xxhash64("doc_id", F.lit(3))
    sample = [known.where(F.col("quality") == q).orderBy(by_hash, "doc_id").limit(per_class) for q in (0, 1)]
    count = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    joined = docs.select("doc_id", "text").join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"quality": batch.column(0), "doc_id": batch.column(1), "x": [x.tobytes() for x in indicators(batch.column(2).to_pylist())]}

    found = materialize(map_batches(joined.select("quality", "doc_id", "text"), "quality int, doc_id long, x binary", run, 1 << 20), "nbsvm-sample")
    # The bound is found on the sizes alone; what lies beyond it is never gathered.
    upto = F.sum("size").over(Window.partitionBy("quality").orderBy(by_hash, "doc_id"))
    within = found.select("quality", "doc_id", F.octet_length("x").alias("size")).withColumn("upto", upto).where(F.col("upto") <= class_bytes)
    got = found.join(F.broadcast(within.select("quality", "doc_id")), ["quality", "doc_id"]).orderBy(by_hash, "doc_id").select("quality", "x").collect()
    discard(found)
    return fit([np.frombuffer(r.x, np.int32) for r in got], np.array([r.quality for r in got], np.int64), (count.get(0, 0), count.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores = [sent.value.score(x) for x in indicators(batch.column(1).to_pylist())]
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return map_batches(docs.select("doc_id", "text", held.alias("held_out")), "doc_id long, held_out boolean, score double, predicted int", run, 1 << 20)
