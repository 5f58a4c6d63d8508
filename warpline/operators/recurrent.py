"""Recurrent layers over sequences of vectors: one row per sequence, many sequences a batch, in numpy.

A step depends on the one before it, so it is a loop over time; sequences are independent and the rows of a
batch go through a step together. Shorter sequences keep their last state; null or empty ones stay zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def rnn_step(x, h, c, w):
    return np.tanh(x @ w["wx"] + h @ w["wh"] + w["b"]), c


def lstm_step(x, h, c, w):
    """Gates in the order forget, candidate, input, output."""
    n = h.shape[1]
    a = x @ w["wx"] + h @ w["wh"] + w["b"]
    f, g, i, o = _sigmoid(a[:, :n]), np.tanh(a[:, n : 2 * n]), _sigmoid(a[:, 2 * n : 3 * n]), _sigmoid(a[:, 3 * n :])
    c = f * c + g * i
    return o * np.tanh(c), c


def gru_step(x, h, c, w):
    """Gates in the order update, reset, candidate."""
    n = h.shape[1]
    z = _sigmoid(x @ w["wx"][:, :n] + h @ w["wh"][:, :n] + w["b"][:n])
    r = _sigmoid(x @ w["wx"][:, n : 2 * n] + h @ w["wh"][:, n : 2 * n] + w["b"][n : 2 * n])
    k = np.tanh(x @ w["wx"][:, 2 * n :] + (r * h) @ w["wh"][:, 2 * n :] + w["b"][2 * n :])
    return (1 - z) * h + z * k, c


STEPS = {"rnn": (rnn_step, 1), "lstm": (lstm_step, 4), "gru": (gru_step, 3)}


def weights(kind: str, inputs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng, n = np.random.default_rng(seed), STEPS[kind][1]
    return {"wx": rng.normal(0, inputs**-0.5, (inputs, n * hidden)), "wh": rng.normal(0, hidden**-0.5, (hidden, n * hidden)), "b": np.zeros(n * hidden)}


def states(kind: str, sequences: list, w: dict[str, np.ndarray], backwards: bool = False) -> list[np.ndarray]:
    """The hidden state after each step of each sequence."""
    step, n = STEPS[kind]
    hidden = w["wh"].shape[0]
    xs = [np.array([list(v) for v in s], float).reshape(-1, w["wx"].shape[0]) if s is not None and len(s) else np.zeros((0, w["wx"].shape[0])) for s in sequences]
    if backwards:
        xs = [x[::-1] for x in xs]
    h, c = np.zeros((len(xs), hidden)), np.zeros((len(xs), hidden))
    out = [[] for _ in xs]
    for t in range(max((len(x) for x in xs), default=0)):
        live = np.array([i for i, x in enumerate(xs) if t < len(x)])
        h[live], c[live] = step(np.stack([xs[i][t] for i in live]), h[live], c[live], w)
        for i in live:
            out[i].append(h[i].copy())
    arrays = [np.array(o).reshape(-1, hidden) for o in out]
    return [a[::-1] for a in arrays] if backwards else arrays


def encoded(rows: DataFrame, sequence: Column, kind: str, inputs: int, hidden: int, seed: int = 1, both_ways: bool = False) -> DataFrame:
    """rows with ``state``: the last hidden state, or those of both directions one after the other."""
    w = weights(kind, inputs, hidden, seed)
    v = weights(kind, inputs, hidden, seed + 1)

    def last(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in s:
            ends = [x[-1] if len(x) else np.zeros(hidden) for x in states(kind, list(b), w)]
            if both_ways:
                ends = [np.concatenate([e, x[0] if len(x) else np.zeros(hidden)]) for e, x in zip(ends, states(kind, list(b), v, backwards=True), strict=True)]
            yield pd.Series(ends)

    return rows.withColumn("state", F.pandas_udf(last, "array<double>")(sequence))
