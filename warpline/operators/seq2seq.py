"""Encoder and decoder networks over characters: training, greedy decoding, attention weights.

Both sides are LSTM layers (gates in the order forget, candidate, input, output); the decoder starts with the encoder's
last state. With attention every decoder state also asks all encoder states, and the mean of these, weighted by the
softmax of their products, goes into the scores beside it. A training of one condition and seed is a loop over batches and
runs in one task, so its pairs must be a bounded set; conditions and seeds spread over tasks.

Defined results: pairs with a null or empty side are passed over; questions and answers are filled with blanks to the
longest; a condition without pairs gives no rows; repeated pairs count as often as they stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.recurrent import _sigmoid

Weights = dict[str, np.ndarray]
START = "_"


def lstm_forward(x: np.ndarray, h: np.ndarray, w: Weights, side: str, c: np.ndarray | None = None) -> tuple[np.ndarray, list, np.ndarray]:
    """(states (n, steps, hidden), what the way back needs, last cell) of (n, steps, inputs) from the state h and the cell c."""
    c, states, kept = np.zeros_like(h) if c is None else c, [], []
    n = h.shape[1]
    for t in range(x.shape[1]):
        a = x[:, t] @ w[f"{side}x"] + h @ w[f"{side}h"] + w[f"{side}b"]
        f, g, i, o = _sigmoid(a[:, :n]), np.tanh(a[:, n : 2 * n]), _sigmoid(a[:, 2 * n : 3 * n]), _sigmoid(a[:, 3 * n :])
        new = f * c + g * i
        kept.append((x[:, t], h, c, f, g, i, o, np.tanh(new)))
        c, h = new, o * np.tanh(new)
        states.append(h)
    return np.stack(states, 1), kept, c


def lstm_backward(d: np.ndarray, kept: list, w: Weights, side: str, grads: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(gradients of the inputs, of the first state) from those of the states; the parameters' are added to ``grads``."""
    dx, dh, dc = [], np.zeros_like(d[:, 0]), np.zeros_like(d[:, 0])
    for t in reversed(range(len(kept))):
        x, h, c, f, g, i, o, tc = kept[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * c * f * (1 - f), dc * i * (1 - g * g), dc * g * i * (1 - i), dh * tc * o * (1 - o)], 1)
        grads[f"{side}x"] += x.T @ da
        grads[f"{side}h"] += h.T @ da
        grads[f"{side}b"] += da.sum(0)
        dx.append(da @ w[f"{side}x"].T)
        dh, dc = da @ w[f"{side}h"].T, dc * f
    return np.stack(dx[::-1], 1), dh


def made(letters: int, size: int, hidden: int, attention: bool, rng: np.random.Generator) -> Weights:
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {"e": rng.normal(0, 0.1, (letters, size)), "wo": normal(hidden * (2 if attention else 1), letters), "bo": np.zeros(letters)}
    for side in ("q", "a"):
        w |= {f"{side}x": normal(size, 4 * hidden), f"{side}h": normal(hidden, 4 * hidden), f"{side}b": np.zeros(4 * hidden)}
    return w


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def step(w: Weights, q: np.ndarray, a: np.ndarray) -> tuple[float, Weights]:
    """(mean loss of a character, gradients) for questions (n, m) and answers (n, k) of character numbers, the first being the start."""
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    hidden = w["qh"].shape[0]
    attention = len(w["wo"]) == 2 * hidden
    he, kept_e, _ = lstm_forward(w["e"][q], np.zeros((len(q), hidden)), w, "q")
    hd, kept_d, _ = lstm_forward(w["e"][a[:, :-1]], he[:, -1], w, "a")
    top = hd
    if attention:
        p = _softmax(hd @ he.transpose(0, 2, 1))
        top = np.concatenate([p @ he, hd], 2)
    y = _softmax(top @ w["wo"] + w["bo"])
    rows, places = np.indices(a[:, 1:].shape)
    n = a[:, 1:].size
    loss = float(-np.log(y[rows, places, a[:, 1:]] + 1e-12).sum() / n)
    y[rows, places, a[:, 1:]] -= 1
    y /= n
    grads["wo"] += np.einsum("ntk,ntv->kv", top, y)
    grads["bo"] += y.sum((0, 1))
    back = y @ w["wo"].T
    dd, de = back[..., -hidden:].copy(), np.zeros_like(he)
    if attention:
        mean = back[..., :hidden]
        dp = mean @ he.transpose(0, 2, 1)
        ds = p * (dp - (dp * p).sum(-1, keepdims=True))
        dd += ds @ he
        de += ds.transpose(0, 2, 1) @ hd + p.transpose(0, 2, 1) @ mean
    dx, first = lstm_backward(dd, kept_d, w, "a", grads)
    np.add.at(grads["e"], a[:, :-1], dx)
    de[:, -1] += first
    dx, _ = lstm_backward(de, kept_e, w, "q", grads)
    np.add.at(grads["e"], q, dx)
    return loss, grads


def decoded(w: Weights, q: np.ndarray, start: int, length: int, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(characters (n, length), attention weights (n, length, m)): the likeliest character each time, or those ``given``, is read on.

    The weights are empty without attention.
    """
    hidden = w["qh"].shape[0]
    attention = len(w["wo"]) == 2 * hidden
    he, _, _ = lstm_forward(w["e"][q], np.zeros((len(q), hidden)), w, "q")
    h, c, last, out, weights = he[:, -1], np.zeros((len(q), hidden)), np.full(len(q), start), [], []
    for t in range(length):
        a = w["e"][last] @ w["ax"] + h @ w["ah"] + w["ab"]
        n = hidden
        c = _sigmoid(a[:, :n]) * c + np.tanh(a[:, n : 2 * n]) * _sigmoid(a[:, 2 * n : 3 * n])
        h = _sigmoid(a[:, 3 * n :]) * np.tanh(c)
        top = h
        if attention:
            p = _softmax(np.einsum("nh,nmh->nm", h, he))
            weights.append(p)
            top = np.concatenate([np.einsum("nm,nmh->nh", p, he), h], 1)
        best = (top @ w["wo"] + w["bo"]).argmax(1)
        out.append(best)
        last = best if given is None else given[:, t]
    return np.stack(out, 1), np.stack(weights, 1) if attention else np.zeros((len(q), length, 0))


def fitted(w: Weights, q: np.ndarray, a: np.ndarray, epochs: int, batch: int, rate: float, limit: float, rng: np.random.Generator) -> list[float]:
    """The loss of each epoch; ``w`` is changed by Adam on gradients clipped to a common norm."""
    m, v, losses, t = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, [], 0
    m, v = m
    for _ in range(epochs):
        total = 0.0
        for at in np.array_split(rng.permutation(len(q)), max(1, len(q) // batch)):
            loss, g = step(w, q[at], a[at])
            clip = min(1.0, limit / (np.sqrt(sum((x * x).sum() for x in g.values())) + 1e-6))
            t += 1
            for k in w:
                m[k] += 0.1 * (clip * g[k] - m[k])
                v[k] += 0.001 * ((clip * g[k]) ** 2 - v[k])
                w[k] -= rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-7)
            total += loss * len(at)
        losses.append(total / len(q))
    return losses


def trained(pairs: DataFrame, attention: bool = False, backwards: bool = True, seeds: int = 2, size: int = 16, hidden: int = 64, epochs: int = 20, batch: int = 32, rate: float = 0.005, limit: float = 5.0) -> DataFrame:
    """(condition, seed, losses, exact_match, predictions, weights) of pairs (condition, question, answer), read backwards by default.

    ``predictions``: the greedy answers (question, answer, guess, token_correct); ``weights``: of each of them the
    attention (a row an answer's character, a column a question's, in the question's own order), null without it.
    """
    runs = pairs.where("question <> '' and answer <> ''").select("condition", "question", "answer", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    columns = ["condition", "seed", "losses", "exact_match", "predictions", "weights"]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        condition, seed = pdf["condition"].iloc[0], int(pdf["seed"].iloc[0])
        rows = sorted(zip(pdf["question"], pdf["answer"].str.removeprefix(START), strict=True))
        letters = sorted({c for r in rows for c in "".join(r)} | {" ", START})
        number = {c: k for k, c in enumerate(letters)}
        wide = [max(len(r[k]) for r in rows) for k in (0, 1)]
        code = lambda text, n: [number[c] for c in text.ljust(n)]
        q = np.array([code(r[0], wide[0]) for r in rows])
        q = q[:, ::-1] if backwards else q
        a = np.array([[number[START], *code(r[1], wide[1])] for r in rows])
        rng = np.random.default_rng(seed)
        w = made(len(letters), size, hidden, attention, rng)
        losses = fitted(w, q, a, epochs, batch, rate, limit, rng)
        guess, weights = decoded(w, q, number[START], wide[1])
        told = [("".join(letters[c] for c in g)).rstrip() for g in guess]
        out = [{"question": r[0], "answer": r[1], "guess": g, "token_correct": sum(x == y for x, y in zip(r[1].ljust(wide[1]), g.ljust(wide[1]), strict=True))} for r, g in zip(rows, told, strict=True)]
        exact = float(np.mean([o["guess"] == o["answer"].rstrip() for o in out]))
        shown = [p[:, ::-1].tolist() if backwards else p.tolist() for p in weights] if attention else None
        return pd.DataFrame([(condition, seed, losses, exact, out, shown)], columns=columns)

    kind = "array<struct<question:string,answer:string,guess:string,token_correct:int>>"
    return runs.groupBy("condition", "seed").applyInPandas(train, f"condition string, seed int, losses array<double>, exact_match double, predictions {kind}, weights array<array<array<double>>>")
