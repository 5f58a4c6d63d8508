"""What goes on around trainings: layers with named state, optimisers with hooks, receivers of events, snapshots, registries.

Plain objects of one training, which runs in one task; what spreads over a cluster is the trainings.
"""

from __future__ import annotations

import copy
import io
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np

Arrays = dict[str, np.ndarray]


class Layer:
    """Named parameters and buffers, those of inner layers under ``name.``; a mode for training and one for evaluation."""

    def __init__(self, **inner: Layer) -> None:
        self.parameters_: Arrays = {}
        self.buffers_: Arrays = {}
        self.inner = dict(inner)
        self.training = True

    def _named(self, kind: str) -> Iterator[tuple[str, np.ndarray]]:
        yield from getattr(self, kind).items()
        for name, layer in self.inner.items():
            for below, value in layer._named(kind):
                yield f"{name}.{below}", value

    def parameters(self) -> Arrays:
        return dict(self._named("parameters_"))

    def buffers(self) -> Arrays:
        return dict(self._named("buffers_"))

    def train(self, on: bool = True) -> Layer:
        self.training = on
        for layer in self.inner.values():
            layer.train(on)
        return self

    def eval(self) -> Layer:
        return self.train(False)

    def elements(self) -> int:
        """The numbers in all parameters; one array that two layers share counts once."""
        return sum(a.size for a in {id(a): a for a in self.parameters().values()}.values())

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"p:{k}": v for k, v in self.parameters().items()}, **{f"b:{k}": v for k, v in self.buffers().items()})
        return out.getvalue()

    def load(self, data: bytes) -> Layer:
        """Fill all parameters and buffers; other names or shapes raise before anything is changed."""
        with np.load(io.BytesIO(data)) as z:
            stored = {k: z[k] for k in z.files}
        own = {f"p:{k}": v for k, v in self.parameters().items()} | {f"b:{k}": v for k, v in self.buffers().items()}
        if set(stored) != set(own):
            raise ValueError(f"other names are stored: {sorted(set(stored) ^ set(own))}")
        for k, v in own.items():
            if v.shape != stored[k].shape:
                raise ValueError(f"{k} is stored with the shape {stored[k].shape}")
        for k, v in own.items():
            v[...] = stored[k]
        return self


class Optimizer:
    """Steps of a rule with what comes around them: ``before``, transforms of gradients, the rule, ``after``.

    The rule changes a parameter in place: rule(name, parameter, gradient, state, step). State is kept per name.
    """

    def __init__(self, rule: Callable, *transforms: Callable[[Arrays, Arrays], Arrays]) -> None:
        self.rule, self.transforms = rule, list(transforms)
        self.before: list[Callable] = []
        self.after: list[Callable] = []
        self.state: dict[str, Arrays] = {}
        self.steps = 0

    def step(self, parameters: Arrays, gradients: Arrays) -> None:
        for f in self.before:
            f(self, parameters, gradients)
        for f in self.transforms:
            gradients = f(parameters, gradients)
        self.steps += 1
        for k in parameters:
            if k in gradients:
                self.rule(k, parameters[k], gradients[k], self.state.setdefault(k, {}), self.steps)
        for f in self.after:
            f(self, parameters, gradients)

    def saved(self) -> dict:
        return copy.deepcopy({"steps": self.steps, "state": self.state})

    def load(self, saved: dict) -> None:
        self.steps, self.state = saved["steps"], copy.deepcopy(saved["state"])


def weight_decay(factor: float) -> Callable[[Arrays, Arrays], Arrays]:
    """L2 for matrices and more; vectors, as biases, are left alone."""
    return lambda p, g: {k: v + factor * p[k] if p[k].ndim >= 2 else v for k, v in g.items()}


def norm_limit(most: float) -> Callable[[Arrays, Arrays], Arrays]:
    """All gradients by one factor, so that their common norm is at most ``most``."""

    def limited(_: Arrays, g: Arrays) -> Arrays:
        factor = min(1.0, most / (np.sqrt(sum(float((v * v).sum()) for v in g.values())) + 1e-6))
        return {k: v * factor for k, v in g.items()}

    return limited


def momentum(rate: float, keep: float = 0.9) -> Callable:
    def rule(_: str, p: np.ndarray, g: np.ndarray, state: Arrays, step: int) -> None:
        v = state.setdefault("v", np.zeros_like(p))
        v *= keep
        v -= rate * g
        p += v

    return rule


# ---- events ----


class Queue:
    """A bounded queue between a training and what stores its events: progress is dropped when it is full, all else makes room first.

    ``store`` takes a list of events and is called with at most ``chunk`` of them; ``close`` stores the rest and then calls ``finalise`` once.
    """

    def __init__(self, store: Callable[[list], None], finalise: Callable[[], None] = lambda: None, size: int = 256, chunk: int = 100) -> None:
        self.store, self.finalise, self.size, self.chunk = store, finalise, size, chunk
        self.held: deque = deque()
        self.dropped, self.closed = 0, False

    def put(self, event: dict, droppable: bool = False) -> bool:
        if self.closed:
            raise RuntimeError("the queue is closed")
        if len(self.held) >= self.size:
            if droppable:
                self.dropped += 1
                return False
            self.drain(self.chunk)
        self.held.append(event)
        return True

    def drain(self, most: int | None = None) -> None:
        left = len(self.held) if most is None else min(most, len(self.held))
        while left:
            part = [self.held.popleft() for _ in range(min(self.chunk, left))]
            left -= len(part)
            self.store(part)

    def close(self) -> None:
        if not self.closed:
            self.drain()
            self.closed = True
            self.finalise()


class Events:
    """Hands every event to the receivers of its kind, those of all kinds last, in the order in which they were added.

    Every ``evaluate_every``-th update asks for an evaluation first, and the window of updates since the last one is closed by it.
    """

    def __init__(self, evaluate_every: int = 0) -> None:
        self.receivers: dict[str | None, list[Callable[[dict], None]]] = {}
        self.evaluate_every, self.updates, self.window = evaluate_every, 0, []

    def on(self, kind: str | None, receiver: Callable[[dict], None]) -> Events:
        self.receivers.setdefault(kind, []).append(receiver)
        return self

    def send(self, kind: str, **fields) -> None:
        event = {"kind": kind, **fields}
        for receiver in [*self.receivers.get(kind, []), *self.receivers.get(None, [])]:
            receiver(event)
        if kind == "update":
            self.updates += 1
            self.window.append(fields)
            if self.evaluate_every and self.updates % self.evaluate_every == 0:
                self.send("evaluate", update=self.updates)
                self.close_window("probe")
        elif kind in ("epoch_end", "terminal"):
            self.close_window(kind)

    def close_window(self, by: str) -> None:
        if self.window:
            closed, self.window = self.window, []
            self.send("window", by=by, updates=len(closed), seconds=sum(f.get("seconds", 0.0) for f in closed))


@contextmanager
def undisturbed(rng: np.random.Generator, *states: np.ndarray | Layer):
    """Evaluate without a trace: the generator, arrays such as recurrent states, and layers with their mode come back as they were."""
    kept = copy.deepcopy(rng.bit_generator.state)
    arrays = [(s, s.copy()) for s in states if isinstance(s, np.ndarray)]
    layers = [(s, s.saved(), s.training) for s in states if isinstance(s, Layer)]
    for layer, _, _ in layers:
        layer.eval()
    try:
        yield
    finally:
        rng.bit_generator.state = kept
        for a, b in arrays:
            a[...] = b
        for layer, saved, training in layers:
            layer.load(saved)
            layer.train(training)


# ---- look-ups ----


class Kinds:
    """What is made by its kind: executors, initialisers, plug-ins of studies. A kind is registered once."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def add(self, kind: str, make: Callable) -> Callable:
        if kind in self.known:
            raise ValueError(f"{kind} is registered twice")
        self.known[kind] = make
        return make

    def make(self, kind: str, *args, **settings):
        if kind not in self.known:
            raise KeyError(f"{kind} is none of {sorted(self.known)}")
        return self.known[kind](*args, **settings)


def first_there(candidates: Iterable[str], there: Callable[[str], bool]) -> str | None:
    """The first place that has the artifact: local mirror, cache, remote, as they are given."""
    return next((c for c in candidates if there(c)), None)


def pages(fetch: Callable[[str | None, int], tuple[list, str | None]], size: int = 1000) -> Iterator:
    """All items of a search that gives them page by page: fetch(token, size) gives the items and the next token, none at the end."""
    token, seen = None, set()
    while True:
        items, token = fetch(token, size)
        yield from items
        if not token:
            return
        if token in seen:
            raise RuntimeError("the search gives the same page again")
        seen.add(token)
