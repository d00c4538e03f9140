"""Routers: for a vector, a probability for each bucket of a level."""

from __future__ import annotations

import base64
import io
from typing import Protocol

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..config import IndexConfig
from ..functions.distance import half, scores, softmax


#: Rows by buckets that are worked out at a time; rows and numbers of the sample that trains a router.
CELLS, TRAINED, NUMBERS = 1 << 20, 1 << 16, 1 << 24


class Router(Protocol):
    n_buckets: int

    def probabilities(self, vectors: np.ndarray) -> np.ndarray: ...

    def arrays(self) -> dict[str, np.ndarray]: ...


class CentroidRouter:
    """Softmax of scaled nearness to one centroid a bucket."""

    kind = "centroid"

    def __init__(self, centroids: np.ndarray, metric: str = "dot", scale: float = 8.0):
        self.centroids, self.metric, self.scale, self.n_buckets = np.asarray(centroids, np.float64), metric, scale, len(centroids)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return softmax(self.scale * scores(self.metric, np.asarray(vectors, np.float64), self.centroids))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"centroids": self.centroids, "scale": np.array(self.scale), "metric": np.array(self.metric)}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> CentroidRouter:
        return cls(arrays["centroids"], str(arrays["metric"]), float(arrays["scale"]))


def class_weights(labels: np.ndarray) -> np.ndarray:
    """For each row one over the rows of its label."""
    return 1 / np.bincount(labels)[labels]


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """rows with ``weight``: class_weights of a whole table; rows without label are a class too."""
    sizes = rows.groupBy(F.col(label).alias("_label")).agg((1 / F.count(F.lit(1))).alias("weight"))
    return rows.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


class MlpRouter:
    """Linear and ReLU layers with a linear output of n_buckets, trained by Adam on class-balanced draws."""

    kind = "mlp"

    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]], relu_after: list[bool], n_buckets: int):
        self.weights, self.relu_after, self.n_buckets = weights, relu_after, n_buckets

    def logits(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        x = np.asarray(x, np.float64)
        for (w, b), relu in zip(self.weights, self.relu_after):
            if trace is not None:
                trace.append(x)
            x = x @ w + b
            if relu:
                x = np.maximum(x, 0)
        return x

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        return softmax(self.logits(vectors))

    def quantized(self) -> MlpRouter:
        """Weights as 16-bit floats keep them; biases stay."""
        return MlpRouter([(half(w).astype(np.float64), b) for w, b in self.weights], self.relu_after, self.n_buckets)

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"relu_after": np.array(self.relu_after), "n_buckets": np.array(self.n_buckets)}
        for i, (w, b) in enumerate(self.weights):
            out |= {f"w{i}": w, f"b{i}": b}
        return out

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> MlpRouter:
        relu = [bool(x) for x in arrays["relu_after"]]
        return cls([(arrays[f"w{i}"], arrays[f"b{i}"]) for i in range(len(relu))], relu, int(arrays["n_buckets"]))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, n_buckets: int, config: IndexConfig) -> MlpRouter:
        rng = np.random.default_rng(config.seed)
        sizes, relu_after = [x.shape[1]], []
        for kind, n in config.layers:
            if kind == "linear":
                sizes.append(n)
                relu_after.append(False)
            elif relu_after:
                relu_after[-1] = True
        sizes.append(n_buckets)
        relu_after.append(False)
        net = cls([(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])], relu_after, n_buckets)
        flat = [p for layer in net.weights for p in layer]
        first, second, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
        weight = class_weights(labels)
        for _ in range(config.train.epochs):
            drawn = rng.choice(len(labels), len(labels), p=weight / weight.sum())
            for at in range(0, len(drawn), config.train.batch_size):
                rows, t, trace = drawn[at : at + config.train.batch_size], t + 1, []
                grad = softmax(net.logits(x[rows], trace))
                grad[np.arange(len(rows)), labels[rows]] -= 1
                grad /= len(rows)
                grads = []
                for i in range(len(net.weights) - 1, -1, -1):
                    grads[:0] = [trace[i].T @ grad, grad.sum(0)]
                    if i:
                        grad = grad @ net.weights[i][0].T * ((trace[i] > 0) if net.relu_after[i - 1] else 1)
                for p, g, m, v in zip(flat, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return net.quantized() if config.quantize else net


KINDS = {c.kind: c for c in (CentroidRouter, MlpRouter)}


def packed(router) -> dict[str, str]:
    out = io.BytesIO()
    np.savez(out, **router.arrays())
    return {"kind": router.kind, "arrays": base64.b64encode(out.getvalue()).decode()}


def unpacked(data: dict[str, str]):
    with np.load(io.BytesIO(base64.b64decode(data["arrays"]))) as arrays:
        return KINDS[data["kind"]].of(dict(arrays))


def sample_size(rows: int, n_buckets: int, threshold: int) -> int:
    return min(rows, max(threshold, 40 * n_buckets))


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by hashed id: the same however the rows are partitioned."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit(str(seed))).cast("binary")), "vec_id").limit(n)


def assigned(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    """The nearest centre of each row, the lower of equals: by the dot product, or by Euclidean distance. CELLS of rows by centres at a time."""
    out, n = np.empty(len(x), np.int64), max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(x), n):
        near = x[at : at + n] @ centres.T
        out[at : at + n] = np.argmax(np.round(near if spherical else 2 * near - (centres**2).sum(1), 12), axis=1)
    return out


def centres_of(sums: np.ndarray, counts: np.ndarray, spherical: bool, before: np.ndarray) -> np.ndarray:
    """New centres of the sums and counts of their rows: means, of length 1 if spherical. One without rows, or without a direction, stays."""
    out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], before)
    if spherical:
        length = np.linalg.norm(out, axis=1)[:, None]
        out = np.where(length > 0, out / np.where(length > 0, length, 1), before)
    return out


def kmeans(x: np.ndarray, k: int, spherical: bool, rounds: int, seed: int) -> np.ndarray:
    """Labels of at most k clusters. First centres are drawn one by one, farther rows likelier (k-means++)."""
    rng = np.random.default_rng(seed)
    if spherical:  # a zero vector has no direction: it gets a fixed one
        length = np.linalg.norm(x, axis=1)[:, None]
        x = np.where(length > 0, x / np.where(length > 0, length, 1), np.eye(1, x.shape[1]))
    square, drawn, far = (x**2).sum(1), [], np.full(len(x), np.inf)
    while len(drawn) < k and far.max() > 0:
        upto = np.cumsum(far) if drawn else None
        drawn.append(min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(x) - 1) if drawn else int(rng.integers(len(x))))
        both = square + square[drawn[-1]]
        away = both - 2 * (x @ x[drawn[-1]])
        far = np.minimum(far, np.where(away > 1e-12 * both, away, 0))  # less is what rounding leaves of equal rows
        far[drawn[-1]] = 0
    centres = x[drawn]
    labels = np.zeros(len(x), int)
    for done in range(rounds):
        now = assigned(x, centres, spherical)
        counts, sums = np.bincount(now, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, now, x)
        centres = centres_of(sums, counts, spherical, centres)
        if done and (now == labels).all():
            break
        labels = now
    return labels


def train_mlp(rows: DataFrame, n_rows: int, level: int, config: IndexConfig) -> MlpRouter:
    """A router for a new level, trained on the driver on a sample of the rows that found it: 40 a bucket, TRAINED rows and NUMBERS numbers at most."""
    k = config.n_buckets(level)
    n = min(sample_size(n_rows, k, config.train.threshold_samples), TRAINED, max(1, NUMBERS // config.input_shape))
    table = sampled(rows, n, config.seed).select("embedding").toArrow()
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("embedding").chunks]).astype(np.float64).reshape(table.num_rows, -1)
    return MlpRouter.fit(x, kmeans(x, min(k, len(x)), config.distance_fn == "dot", config.train.max_iters, config.seed), k, config)
