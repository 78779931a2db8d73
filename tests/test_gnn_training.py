"""Gradients of stacks of graph layers against differences of a loss in numpy."""

import copy

import numpy as np
import pytest

from edgeloom.operators import gnn_training as T

N, DIM, HID, OUT = 7, 3, 4, 2
EDGES = [(0, 0, 1), (0, 1, 2), (1, 0, 2), (3, 1, 0), (3, 0, 3), (4, 0, 1), (0, 0, 1), (5, 1, 4)]
LABELS = [(0, 1), (1, 0), (2, 1), (4, 0), (6, None), (5, 9)]


def act(kind, y):
    return {"none": y, "relu": np.maximum(y, 0), "sigmoid": 1 / (1 + np.exp(-y))}[kind]


def numpy_layer(layer, x):
    w = layer.weights
    if isinstance(layer, T.Sage):
        nbrs = [[b for a, _, b in EDGES if a == i] + [a for a, _, b in EDGES if b == i] for i in range(N)]
        a = np.array([x[n].mean(axis=0) if n else np.zeros(x.shape[1]) for n in nbrs])
        y = x @ w["self"].T + a @ w["nbr"].T
    elif isinstance(layer, T.Gcn):
        adj = np.eye(N)
        for s, _, d in EDGES:
            adj[d, s] += 1
        r = np.sqrt(adj.sum(axis=1))
        y = (adj / r[:, None] / r[None]) @ x @ w["w"].T
    elif isinstance(layer, T.Rgcn):
        y = x @ w["self"].T
        for i in range(N):
            out = [w[str(r)] @ x[d] for s, r, d in EDGES if s == i]
            y[i] += np.mean(out, axis=0) if out else 0
    else:
        z, y = x @ w["w"].T, []
        for i in range(N):
            around = [s for s, _, d in EDGES if d == i] + [i]
            raw = np.array([z[i] @ w["own"][0] + z[j] @ w["nbr"][0] for j in around])
            p = np.exp(np.where(raw > 0, raw, 0.2 * raw))
            y.append((p / p.sum()) @ z[around])
        y = np.array(y)
    return act(layer.activation, y + (0 if layer.bias is None else layer.bias))


def numpy_loss(layers, x):
    for layer in layers:
        x = numpy_layer(layer, x)
    known = [(i, l) for i, l in LABELS if l is not None and l < OUT]
    return np.mean([np.log(np.exp(x[i]).sum()) - x[i][l] for i, l in known])


def weights(kind, rng, out, dim):
    make = lambda *s: rng.normal(size=s) * 0.7
    return {
        T.Sage: lambda: {"self": make(out, dim), "nbr": make(out, dim)}, T.Gcn: lambda: {"w": make(out, dim)},
        T.Rgcn: lambda: {"self": make(out, dim), "0": make(out, dim), "1": make(out, dim)}, T.Gat: lambda: {"w": make(out, dim), "own": make(1, out), "nbr": make(1, out)},
    }[kind]()


def tables(spark, x):
    e = spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES)], "edge_id bigint, src bigint, rel int, dst bigint")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id bigint, x array<double>")
    return e, t, spark.createDataFrame(LABELS, "node_id bigint, label int")


@pytest.mark.parametrize("kind", [T.Sage, T.Gcn, T.Rgcn, T.Gat])
def test_gradients_are_slopes(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, DIM))
    layers = [kind(weights(kind, rng, HID, DIM), rng.normal(size=HID), "sigmoid"), kind(weights(kind, rng, OUT, HID), None, "none")]
    found, of_x, loss = T.gradients(*tables(spark, x), layers)
    assert loss == pytest.approx(numpy_loss(layers, x))
    clean = [kind(copy.deepcopy(l.weights), None if l.bias is None else l.bias.copy(), l.activation) for l in layers]
    for layer, of in zip(clean, found):
        for name, g in of.items():
            w = layer.bias if name == "bias" else layer.weights[name]
            for i in np.ndindex(w.shape):
                w[i] += 1e-6
                up = numpy_loss(clean, x)
                w[i] -= 2e-6
                down = numpy_loss(clean, x)
                w[i] += 1e-6
                assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), (name, i)
    got = {r.node_id: r.g for r in of_x.collect()}
    for i in np.ndindex(x.shape):
        d = np.zeros_like(x)
        d[i] = 1e-6
        assert got.get(i[0], [0] * DIM)[i[1]] == pytest.approx((numpy_loss(clean, x + d) - numpy_loss(clean, x - d)) / 2e-6, abs=1e-6)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    e, t, labels = tables(spark, rng.normal(size=(N, DIM)))
    layers = [T.Sage(weights(T.Sage, rng, HID, DIM), np.zeros(HID), "relu"), T.Gcn(weights(T.Gcn, rng, OUT, HID))]
    losses = T.train(e, t, labels, layers, 4, rate=0.1)
    assert losses[-1] < losses[0]
    _, none = T.classification_gradient(t, labels.limit(0))
    assert none == 0.0
