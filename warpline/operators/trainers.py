"""Training of word vectors and of language models per condition and seed, with regularisation and generation of text.

Trainings of one condition and seed are sequential: its examples are gathered in one task, in an order that
doesn't depend on partitions. Conditions and seeds spread over tasks. Words are told apart within a condition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.optimizers import _softmax
from warpline.operators.seq2seq import lstm_backward, lstm_forward

Weights = dict[str, np.ndarray]


def l2(gradients: Weights, weights: Weights, c: float) -> Weights:
    """The gradients plus c p; biases (rank 1) aren't held back."""
    return {k: g + c * weights[k] if g.ndim >= 2 else g for k, g in gradients.items()}


def dropout_mask(shape: tuple[int, ...], ratio: float, rng: np.random.Generator) -> np.ndarray:
    """The inverted mask of training; nothing is to be scaled afterwards."""
    return (rng.random(shape) > ratio) / (1 - ratio) if ratio else np.ones(shape)


def _seeded(rows: DataFrame, seeds: int) -> DataFrame:
    return rows.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))


# ---- word vectors ----


def _negatives(of: np.ndarray, cdf: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k draws a word from the powered unigram distribution, never the word itself."""
    low = np.r_[0.0, cdf[:-1]]
    own = cdf[of] - low[of]
    u = rng.random((len(of), k)) * (1 - own)[:, None]
    u = np.where(u < low[of][:, None], u, u + own[:, None])
    drawn = np.minimum(np.searchsorted(cdf, u, side="right"), len(cdf) - 1)
    return np.where(drawn == of[:, None], (drawn + 1) % len(cdf), drawn)


def word2vec_step(w: Weights, inputs: np.ndarray, there: np.ndarray, candidates: np.ndarray, positive: np.ndarray) -> tuple[float, Weights]:
    """(mean loss of an example, gradients): the mean of the inputs' vectors against the candidates of each example."""
    share = there / np.maximum(there.sum(1, keepdims=True), 1)
    h = (w["in"][inputs] * share[..., None]).sum(1)
    s = (w["out"][candidates] * h[:, None]).sum(2)
    loss = np.maximum(s, 0) - s * positive + np.log1p(np.exp(-np.abs(s)))
    d = (1 / (1 + np.exp(-s)) - positive) / len(s)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    np.add.at(g["out"], candidates, d[..., None] * h[:, None])
    np.add.at(g["in"], inputs, (d[..., None] * w["out"][candidates]).sum(1)[:, None] * share[..., None])
    return float(loss.sum() / len(s)), g


def trained_word2vec(examples: DataFrame, kind: str = "cbow", seeds: int = 3, size: int = 16, epochs: int = 10, batch: int = 64, rate: float = 0.5, negatives: int = 5, decay: float = 0.0) -> DataFrame:
    """(condition, seed, word, vector, losses): the input vectors and the loss of every epoch.

    ``examples``: (condition, context array<string>, target). ``cbow`` tells the target from its context, ``skipgram``
    each word of the context from the target. ``decay`` is the L2 factor. Nulls are passed over. A condition of a single word has no negatives and gives no rows.
    """

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        condition, seed = pdf["condition"].iloc[0], int(pdf["seed"].iloc[0])
        rows = sorted((tuple(w for w in c if w is not None), t) for c, t in zip(pdf["context"], pdf["target"], strict=True) if c is not None and t is not None)
        pairs = [(c, t) for c, t in rows if c] if kind == "cbow" else [([t], w) for c, t in rows for w in c]
        words = sorted({w for c, t in rows for w in (*c, t)})
        out = ["condition", "seed", "word", "vector", "losses"]
        if not pairs or len(words) < 2:
            return pd.DataFrame([], columns=out)
        number = {w: i for i, w in enumerate(words)}
        width = max(len(c) for c, _ in pairs)
        inputs = np.array([[number[w] for w in c] + [0] * (width - len(c)) for c, _ in pairs])
        there = np.array([[1.0] * len(c) + [0.0] * (width - len(c)) for c, _ in pairs])
        target = np.array([number[t] for _, t in pairs])
        p = np.bincount(target, minlength=len(words)) ** 0.75
        cdf = np.cumsum(p) / p.sum()
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.1, (len(words), size)) for k in ("in", "out")}
        losses = []
        for _ in range(epochs):
            total = 0.0
            for at in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
                candidates = np.concatenate([target[at][:, None], _negatives(target[at], cdf, negatives, rng)], 1)
                loss, g = word2vec_step(w, inputs[at], there[at], candidates, (np.arange(negatives + 1) == 0).astype(float))
                for k, x in l2(g, w, decay).items():
                    w[k] -= rate * x
                total += loss * len(at)
            losses.append(total / len(target))
        return pd.DataFrame([(condition, seed, x, w["in"][i].tolist(), losses) for x, i in number.items()], columns=out)

    return _seeded(examples, seeds).groupBy("condition", "seed").applyInPandas(train, "condition string, seed int, word string, vector array<double>, losses array<double>")


# ---- language models ----


def language_weights(words: int, size: int, rng: np.random.Generator) -> Weights:
    return {"e": rng.normal(0, 0.1, (words, size)), "wx": rng.normal(0, size**-0.5, (size, size)), "wh": rng.normal(0, size**-0.5, (size, size)), "b": np.zeros(size), "wo": rng.normal(0, size**-0.5, (size, words)), "bo": np.zeros(words)}


def language_step(w: Weights, x: np.ndarray, y: np.ndarray, h: np.ndarray, ratio: float, rng: np.random.Generator) -> tuple[float, Weights, np.ndarray]:
    """(mean loss, gradients, last state) of a span (streams, steps): the gradient ends where the span begins, the state goes on."""
    n, steps = x.shape
    masks = [(dropout_mask((n, h.shape[1]), ratio, rng), dropout_mask((n, h.shape[1]), ratio, rng)) for _ in range(steps)]
    hs, vs, ps, loss = [h], [], [], 0.0
    for t in range(steps):
        v = w["e"][x[:, t]] * masks[t][0]
        hs.append(np.tanh(v @ w["wx"] + hs[-1] @ w["wh"] + w["b"]))
        p = _softmax((hs[-1] * masks[t][1]) @ w["wo"] + w["bo"])
        loss -= np.log(p[np.arange(n), y[:, t]] + 1e-12).sum()
        vs.append(v)
        ps.append(p)
    g, back = {k: np.zeros_like(v) for k, v in w.items()}, np.zeros_like(h)
    for t in reversed(range(steps)):
        d = ps[t].copy()
        d[np.arange(n), y[:, t]] -= 1
        d /= n * steps
        g["wo"] += (hs[t + 1] * masks[t][1]).T @ d
        g["bo"] += d.sum(0)
        a = ((d @ w["wo"].T) * masks[t][1] + back) * (1 - hs[t + 1] ** 2)
        g["wx"] += vs[t].T @ a
        g["wh"] += hs[t].T @ a
        g["b"] += a.sum(0)
        np.add.at(g["e"], x[:, t], (a @ w["wx"].T) * masks[t][0])
        back = a @ w["wh"].T
    return float(loss / (n * steps)), g, hs[-1]


def lstm_language_weights(words: int, size: int, rng: np.random.Generator) -> Weights:
    normal = lambda *shape: rng.normal(0, size**-0.5, shape)
    return {"e": rng.normal(0, 0.1, (words, size)), "lx": normal(size, 4 * size), "lh": normal(size, 4 * size), "lb": np.zeros(4 * size), "wo": normal(size, words), "bo": np.zeros(words)}


def lstm_language_step(w: Weights, x: np.ndarray, y: np.ndarray, state: tuple[np.ndarray, np.ndarray], ratio: float, rng: np.random.Generator) -> tuple[float, Weights, tuple[np.ndarray, np.ndarray]]:
    """The same with an LSTM layer, whose state is (h, c)."""
    n, steps = x.shape
    below, above = (dropout_mask((n, steps, w["lh"].shape[0]), ratio, rng) for _ in range(2))
    hs, kept, c = lstm_forward(w["e"][x] * below, state[0], w, "l", state[1])
    d = _softmax((hs * above).reshape(n * steps, -1) @ w["wo"] + w["bo"])
    at = np.arange(n * steps)
    loss = -np.log(d[at, y.ravel()] + 1e-12).mean()
    d[at, y.ravel()] -= 1
    d /= n * steps
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["wo"] += (hs * above).reshape(n * steps, -1).T @ d
    g["bo"] += d.sum(0)
    dx, _ = lstm_backward((d @ w["wo"].T).reshape(hs.shape) * above, kept, w, "l", g)
    np.add.at(g["e"], x, dx * below)
    return float(loss), g, (hs[:, -1], c)


def generated(w: Weights, start: int, length: int, rng: np.random.Generator | None = None, skip: tuple[int, ...] = ()) -> list[int]:
    """``length`` words after ``start``: the likeliest each time, or drawn from the model if there is an rng; never one of ``skip``."""
    size = len(w["wo"])
    h, c, word, out = np.zeros((1, size)), np.zeros((1, size)), start, []
    for _ in range(length):
        if "lx" in w:
            states, _, c = lstm_forward(w["e"][[[word]]], h, w, "l", c)
            h = states[:, -1]
        else:
            h = np.tanh(w["e"][[word]] @ w["wx"] + h @ w["wh"] + w["b"])
        p = _softmax(h @ w["wo"] + w["bo"])[0]
        p[list(skip)] = 0.0
        word = int(p.argmax()) if rng is None else int(rng.choice(len(p), p=p / p.sum()))
        out.append(word)
    return out


def trained_language_models(tokens: DataFrame, seeds: int = 3, size: int = 32, epochs: int = 10, streams: int = 4, span: int = 8, rate: float = 1.0, limit: float = 0.5, dropout: float = 0.0, decay: float = 0.0, length: int = 10, kind: str = "rnn") -> DataFrame:
    """(condition, seed, epoch, perplexity, greedy, sampled): a recurrent model (``rnn`` or ``lstm``) of the next word, and texts after the first word.

    ``tokens``: (condition, doc_id, pos, word); the documents follow each other. They are read as parallel streams of equal
    length, ``span`` steps at a time (truncated back-propagation); a last span may be shorter, and fewer than ``streams`` words
    left over at the end aren't read. The perplexity is that of the epoch's training spans. Gradients are clipped to a common norm.
    """

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        condition, seed = pdf["condition"].iloc[0], int(pdf["seed"].iloc[0])
        words, ids = np.unique(pdf.sort_values(["doc_id", "pos"])["word"].to_numpy(dtype=str), return_inverse=True)
        out, n = [], min(streams, len(ids) - 1)
        columns = ["condition", "seed", "epoch", "perplexity", "greedy", "sampled"]
        if n < 1:
            return pd.DataFrame([], columns=columns)
        jump = (len(ids) - 1) // n
        x, y = (ids[k : k + jump * n].reshape(n, jump) for k in (0, 1))
        rng = np.random.default_rng(seed)
        w = (lstm_language_weights if kind == "lstm" else language_weights)(len(words), size, rng)
        forward = lstm_language_step if kind == "lstm" else language_step
        for epoch in range(1, epochs + 1):
            h, total = (np.zeros((n, size)), np.zeros((n, size))) if kind == "lstm" else np.zeros((n, size)), 0.0
            for at in range(0, jump, span):
                a, b = x[:, at : at + span], y[:, at : at + span]
                loss, g, h = forward(w, a, b, h, dropout, rng)
                g = l2(g, w, decay)
                clip = min(1.0, limit / (np.sqrt(sum((v * v).sum() for v in g.values())) + 1e-6))
                for k, v in g.items():
                    w[k] -= rate * clip * v
                total += loss * a.size
            texts = [[str(words[i]) for i in generated(w, int(ids[0]), length, r)] for r in (None, np.random.default_rng(seed))]
            out.append((condition, seed, epoch, float(np.exp(total / x.size)), *texts))
        return pd.DataFrame(out, columns=columns)

    return _seeded(tokens.where("word is not null"), seeds).groupBy("condition", "seed").applyInPandas(train, "condition string, seed int, epoch int, perplexity double, greedy array<string>, sampled array<string>")
