import numpy as np
import pytest

from warpline.operators import lifecycle as L


def affine(n, m, seed=0):
    layer = L.Layer()
    layer.parameters_ = {"w": np.random.default_rng(seed).normal(size=(n, m)), "b": np.zeros(m)}
    layer.buffers_ = {"mean": np.zeros(m)}
    return layer


def test_layers_name_save_and_load_their_state():
    net = L.Layer(first=affine(3, 2), second=affine(2, 1, 1))
    assert list(net.parameters()) == ["first.w", "first.b", "second.w", "second.b"] and net.elements() == 11
    other = L.Layer(first=affine(3, 2, 5), second=affine(2, 1, 6)).load(net.saved())
    assert all((other.parameters()[k] == v).all() for k, v in net.parameters().items())
    with pytest.raises(ValueError, match="shape"):
        L.Layer(first=affine(3, 2), second=affine(2, 2)).load(net.saved())
    with pytest.raises(ValueError, match="names"):
        L.Layer(first=affine(3, 2)).load(net.saved())
    assert not net.eval().inner["first"].training and net.train().inner["second"].training
    tied = L.Layer(a=net.inner["first"], b=net.inner["first"])
    assert tied.elements() == 8


def test_optimizer_order_transforms_and_resuming():
    seen = []
    o = L.Optimizer(L.momentum(0.1), L.weight_decay(0.5), L.norm_limit(1.0))
    o.before.append(lambda *_: seen.append("before"))
    o.after.append(lambda *_: seen.append("after"))
    p = {"w": np.ones((1, 1)), "b": np.ones(1)}
    o.step(p, {"w": np.zeros((1, 1)), "b": np.array([10.0])})
    assert seen == ["before", "after"] and 0.9 <= p["b"][0] < 0.91 and p["w"][0, 0] < 1
    again, q = L.Optimizer(L.momentum(0.1), L.weight_decay(0.5), L.norm_limit(1.0)), {k: v.copy() for k, v in p.items()}
    again.load(o.saved())
    for x, y in ((o, p), (again, q)):
        x.step(y, {"b": np.array([1.0])})
    assert p["b"] == q["b"] and again.steps == 2


def test_queue_drops_progress_only_and_stores_in_chunks():
    stored, ended = [], []
    q = L.Queue(stored.append, lambda: ended.append(len(stored)), size=5, chunk=2)
    assert all(q.put({"n": k}, droppable=True) for k in range(5)) and not q.put({"n": 5}, droppable=True) and q.dropped == 1
    assert q.put({"n": 6}) and stored == [[{"n": 0}, {"n": 1}]]
    q.close()
    q.close()
    assert [e["n"] for part in stored for e in part] == [0, 1, 2, 3, 4, 6] and all(len(p) <= 2 for p in stored) and ended == [3]
    with pytest.raises(RuntimeError):
        q.put({})


def test_events_are_routed_and_close_windows():
    log = []
    e = L.Events(evaluate_every=2).on("window", lambda x: log.append((x["by"], x["updates"], x["seconds"]))).on("evaluate", lambda x: log.append(("asked", x["update"])))
    every = []
    e.on(None, lambda x: every.append(x["kind"]))
    for _ in range(5):
        e.send("update", seconds=1.0)
    e.send("epoch_end")
    e.send("terminal")
    assert log == [("asked", 2), ("probe", 2, 2.0), ("asked", 4), ("probe", 2, 2.0), ("epoch_end", 1, 1.0)]
    assert every.count("update") == 5 and every[-1] == "terminal"


def test_an_evaluation_leaves_no_trace():
    rng, h, net = np.random.default_rng(0), np.ones(3), affine(2, 2)
    w = net.parameters_["w"].copy()
    expected = np.random.default_rng(0).random()
    with pytest.raises(KeyError), L.undisturbed(rng, h, net):
        assert not net.training
        rng.random(7)
        h += 5
        net.parameters_["w"] += 1
        raise KeyError
    assert rng.random() == expected and (h == 1).all() and (net.parameters_["w"] == w).all() and net.training


def test_look_ups_and_pages():
    k = L.Kinds()
    k.add("a", lambda x, y=0: x + y)
    assert k.make("a", 1, y=2) == 3
    with pytest.raises(ValueError):
        k.add("a", int)
    with pytest.raises(KeyError):
        k.make("b")
    assert L.first_there(["local", "cache", "far"], {"cache", "far"}.__contains__) == "cache" and L.first_there([], bool) is None
    data = list(range(25))
    fetch = lambda token, n: (data[int(token or 0) :][:n], str(int(token or 0) + n) if int(token or 0) + n < 25 else None)
    assert list(L.pages(fetch, 10)) == data
    with pytest.raises(RuntimeError):
        list(L.pages(lambda token, n: ([1], "same"), 10))
