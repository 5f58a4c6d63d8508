"""Update rules as expressions over arrays, trajectories by a fold, and training of small models per condition and seed.

Steps of one run depend on each other and are folded within a row (``aggregate`` over a sequence); runs are
independent and are rows or groups of a frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

State = dict[str, Column]


def sgd(s: State, g: Column, rate: float) -> State:
    return {"p": s["p"] - rate * g}


def momentum(s: State, g: Column, rate: float, m: float = 0.9) -> State:
    v = m * s["v"] - rate * g
    return {"p": s["p"] + v, "v": v}


def nesterov(s: State, g: Column, rate: float, m: float = 0.9) -> State:
    """With the velocity after its own update: p += m² v − (1 + m) rate g."""
    v = m * s["v"] - rate * g
    return {"p": s["p"] + m * m * v - (1 + m) * rate * g, "v": v}


def adagrad(s: State, g: Column, rate: float, eps: float = 1e-7) -> State:
    h = s["h"] + g * g
    return {"p": s["p"] - rate * g / (F.sqrt(h) + eps), "h": h}


def rmsprop(s: State, g: Column, rate: float, decay: float = 0.99, eps: float = 1e-7) -> State:
    h = decay * s["h"] + (1 - decay) * g * g
    return {"p": s["p"] - rate * g / (F.sqrt(h) + eps), "h": h}


def adam(s: State, g: Column, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> State:
    t = s["t"] + 1
    m, v = s["m"] + (1 - b1) * (g - s["m"]), s["v"] + (1 - b2) * (g * g - s["v"])
    at = rate * F.sqrt(1 - F.pow(F.lit(b2), t)) / (1 - F.pow(F.lit(b1), t))
    return {"p": s["p"] - at * m / (F.sqrt(v) + eps), "m": m, "v": v, "t": t}


RULES: dict[str, tuple[Callable[..., State], tuple[str, ...], float]] = {
    "sgd": (sgd, (), 0.95), "momentum": (momentum, ("v",), 0.1), "nesterov": (nesterov, ("v",), 0.1),
    "adagrad": (adagrad, ("h",), 1.5), "rmsprop": (rmsprop, ("h",), 0.1), "adam": (adam, ("m", "v", "t"), 0.3),
}


def trajectory(starts: DataFrame, rule: str, gradient: Callable[[Column, str], Column], axes: tuple[str, ...], steps: int, rate: float | None = None) -> DataFrame:
    """(starts.*, step, axes): the path of an optimiser from each start; the fold keeps the states of all axes in a struct."""
    update, more, usual = RULES[rule]
    rate = usual if rate is None else rate
    cell = lambda p: F.struct(p.alias("p"), *[F.lit(0.0).alias(k) for k in more])
    first = F.struct(*[cell(F.col(a).cast("double")).alias(a) for a in axes])

    def step(acc, _):
        last = F.element_at(acc, -1)
        new = []
        for a in axes:
            s = {k: last[a][k] for k in ("p", *more)}
            n = update(s, gradient(s["p"], a), rate)
            new.append(F.struct(*[n[k].alias(k) for k in ("p", *more)]).alias(a))
        return F.concat(acc, F.array(F.struct(*new)))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(first), step)
    keep = [c for c in starts.columns if c not in axes]
    return starts.select(*keep, F.posexplode(path).alias("step", "s")).select(*keep, "step", *[F.col(f"s.{a}.p").alias(a) for a in axes])


def clipped(gradients: DataFrame, key: str, value: str, limit: float, eps: float = 1e-6) -> DataFrame:
    """Gradients scaled down so that their common norm per key is at most ``limit``."""
    norms = gradients.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    rate = F.least(F.lit(1.0), F.lit(limit) / (F.col("norm") + eps))
    return gradients.join(norms, key).withColumn(value, F.col(value) * rate)


def sparse_adam_step(table: DataFrame, gradients: DataFrame, step: int, rate: float = 0.001, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> DataFrame:
    """(row, p, m, v): only rows with a gradient change; the moments of the others don't decay. Repeated rows' gradients add up."""
    g = gradients.groupBy("row").agg(F.sum("g").alias("g"))
    at = rate * (1 - b2**step) ** 0.5 / (1 - b1**step)
    m = F.col("m") + (1 - b1) * (F.col("g") - F.col("m"))
    v = F.col("v") + (1 - b2) * (F.col("g") * F.col("g") - F.col("v"))
    rows = table.join(g, "row", "left")
    touched = F.col("g").isNotNull()
    return rows.select("row", F.when(touched, F.col("p") - at * m / (F.sqrt(v) + eps)).otherwise(F.col("p")).alias("p"), F.when(touched, m).otherwise(F.col("m")).alias("m"), F.when(touched, v).otherwise(F.col("v")).alias("v"))


def trained_classifiers(examples: DataFrame, seeds: int = 3, hidden: int = 16, epochs: int = 20, batch: int = 32, rate: float = 0.1) -> DataFrame:
    """(condition, seed, epoch, loss, accuracy) of a two-layer network per condition and seed.

    ``examples``: (condition, x array<double>, label). A condition's examples are one training set and are
    gathered in one task, as sequential training needs them; conditions and seeds spread over tasks.
    """
    runs = examples.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        condition, seed = pdf["condition"].iloc[0], int(pdf["seed"].iloc[0])
        x, y = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy()
        order = np.lexsort((*x.T[:3], y))
        x, y = x[order], y[order]
        rng = np.random.default_rng(seed)
        classes = int(y.max()) + 1
        w1, b1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
        w2, b2 = rng.normal(0, np.sqrt(2 / hidden), (hidden, classes)), np.zeros(classes)
        out = []
        for epoch in range(1, epochs + 1):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a = np.maximum(0, x[at] @ w1 + b1)
                p = _softmax(a @ w2 + b2)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                d = (p @ w2.T) * (a > 0)
                w2 -= rate * a.T @ p
                b2 -= rate * p.sum(0)
                w1 -= rate * x[at].T @ d
                b1 -= rate * d.sum(0)
            p = _softmax(np.maximum(0, x @ w1 + b1) @ w2 + b2)
            out.append((condition, seed, epoch, float(-np.log(p[np.arange(len(y)), y] + 1e-7).mean()), float((p.argmax(1) == y).mean())))
        return pd.DataFrame(out, columns=["condition", "seed", "epoch", "loss", "accuracy"])

    return runs.groupBy("condition", "seed").applyInPandas(train, "condition string, seed int, epoch int, loss double, accuracy double")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
