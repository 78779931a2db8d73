"""Gradients against differences of the loss, steps against numpy, and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import optim, scoring, training


def loss_of(decoder, loss, s, r, t, v, owner):
    op, compare, sign = scoring.DECODERS[decoder]
    q = scoring._NUMPY[op](s, r)
    return training.loss_and_slopes(loss, scoring._NUMPY[compare](q, t) * sign, scoring._NUMPY[compare](q[owner], v) * sign, owner)[0].sum()


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
@pytest.mark.parametrize("loss", training.LOSSES)
def test_gradients_are_slopes(decoder, loss):
    rng = np.random.default_rng(1)
    s, r, t, v = (rng.normal(size=(k, 4)) for k in (3, 3, 3, 5))
    owner = np.array([0, 0, 1, 2, 2])
    op, compare, sign = scoring.DECODERS[decoder]
    q = scoring._NUMPY[op](s, r)
    _, d_pos, d_neg = training.loss_and_slopes(loss, scoring._NUMPY[compare](q, t) * sign, scoring._NUMPY[compare](q[owner], v) * sign, owner)
    dq, dt = training.comparator_back(compare, q, t, d_pos)
    dq_neg, dv = training.comparator_back(compare, q[owner], v, d_neg)
    np.add.at(dq, owner, dq_neg)
    ds, dr = training.operator_back(op, s, r, dq)
    for x, g in ((s, ds), (r, dr), (t, dt), (v, dv)):
        for i in range(x.shape[0]):
            for k in range(4):
                x[i, k] += 1e-6
                up = loss_of(decoder, loss, s, r, t, v, owner)
                x[i, k] -= 2e-6
                down = loss_of(decoder, loss, s, r, t, v, owner)
                x[i, k] += 1e-6
                assert g[i, k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_generator_slopes():
    rng = np.random.default_rng(2)
    logits, reward, owner = rng.normal(size=5), rng.normal(size=5), np.array([0, 0, 0, 1, 1])
    _, got = training.generator_slopes(logits, reward, owner, 2)
    for k in range(5):
        d = np.eye(5)[k] * 1e-6
        up, down = (training.generator_slopes(logits + x, reward, owner, 2)[0].sum() for x in (d, -d))
        assert got[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_odd_values():
    value, d_pos, d_neg = training.loss_and_slopes("softmax_ce", np.array([800.0, 0.0]), np.array([900.0]), np.array([0]))
    assert value == pytest.approx([100, 0]) and d_pos == pytest.approx([-1, 0]) and d_neg == pytest.approx([1])  # the second edge has no negative
    value, d_pos, _ = training.loss_and_slopes("bce_sigmoid", np.array([-500.0]), np.zeros(0), np.zeros(0, dtype=int))
    assert value == scoring.LOG_BOUND and d_pos == 0
    x = np.ones((1, 4))
    for compare in ("l2", "cosine"):
        for y in (x, 0 * x):
            assert all(np.isfinite(g).all() for g in training.comparator_back(compare, x, y, np.ones(1)))


def table(spark, name, x, **more):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, f"{name} bigint, x array<double>")
    return t.withColumns({k: F.array_repeat(F.lit(v), x.shape[1]) for k, v in more.items()})


@pytest.mark.parametrize("decoder,loss,reduction", [("distmult", "softmax_ce", "sum"), ("transe", "ranking", "mean"), ("complex", "bce_logits", "mean"), ("cosine", "mse", "sum")])
def test_a_step_against_numpy(spark, decoder, loss, reduction):
    rng = np.random.default_rng(3)
    x, r = rng.normal(size=(6, 4)), rng.normal(size=(2, 4))
    edges = [(0, 0, 0, 1), (1, 1, 1, 2), (2, 5, 0, 0), (3, 2, 0, 99)]  # the last has no vector
    pairs = [(0, 3), (0, 4), (1, 0), (1, 77), (3, 1)]
    e = spark.createDataFrame(edges, "edge_id bigint, src bigint, rel bigint, dst bigint")
    rule = optim.DenseRule("adam", 0.05)
    rel = rule.start(table(spark, "rel", r))
    new, new_rel, value = training.step(e, spark.createDataFrame(pairs, "edge_id bigint, neg bigint"), table(spark, "node_id", x, state=0.1), rel, decoder, loss, reduction=reduction, dense=rule)
    src, kind, dst, neg, owner = np.array([0, 1, 5]), np.array([0, 1, 0]), np.array([1, 2, 0]), np.array([3, 4, 0]), np.array([0, 0, 1])
    terms = {"sum": 1, "mean": 3 if loss == "ranking" else 6}[reduction]
    assert value == pytest.approx(loss_of(decoder, loss, x[src], r[kind], x[dst], x[neg], owner) / terms)

    def total(x, r):
        return loss_of(decoder, loss, x[src], r[kind], x[dst], x[neg], owner) / terms

    def slopes(a, f):
        g = np.zeros_like(a)
        for i in np.ndindex(a.shape):
            d = np.zeros_like(a)
            d[i] = 1e-6
            g[i] = (f(a + d) - f(a - d)) / 2e-6
        return g

    g = slopes(x, lambda a: total(a, r))
    assert np.array([q.x for q in new.orderBy("node_id").collect()]) == pytest.approx(x - 0.1 * g / np.sqrt(0.1 + g * g), abs=1e-5)
    dense = optim.Dense("adam", 0.05)
    want = dense.step(r, slopes(r, lambda a: total(x, a)))
    assert np.array([q.x for q in new_rel.orderBy("rel").collect()]) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("kind,more", [("sgd", {"decay": 0.1}), ("adagrad", {}), ("adam", {}), ("adam", {"amsgrad": True, "decay": 0.01})])
def test_dense_rules_follow_the_arrays(spark, kind, more):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 2))
    rule, one = optim.DenseRule(kind, 0.1, **more), optim.Dense(kind, 0.1, **more)
    t = rule.start(table(spark, "rel", x))
    for step in range(1, 4):
        g = rng.normal(size=(3, 2))
        g[2] = 0  # has no row
        t = rule.apply(t, table(spark, "rel", g).filter("rel < 2").withColumnRenamed("x", "g"), "rel", step)
        x = one.step(x, g)
    assert np.array([r.x for r in t.orderBy("rel").collect()]) == pytest.approx(x)


@pytest.mark.parametrize("decoder", ["distmult", "transe", "complex"])
def test_steps_lower_the_loss(spark, decoder):
    rng = np.random.default_rng(5)
    nodes, rule = table(spark, "node_id", rng.normal(size=(6, 4)), state=0.1), optim.DenseRule("adagrad", 0.05)
    rel = rule.start(table(spark, "rel", rng.normal(size=(2, 4))))
    e = spark.createDataFrame([(i, i, i % 2, (i + 1) % 6) for i in range(6)], "edge_id bigint, src bigint, rel bigint, dst bigint")
    pairs = e.select("edge_id", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("k")).select("edge_id", ((F.col("edge_id") + F.col("k")) % 6).alias("neg"))
    values = []
    for step in range(1, 5):
        new, new_rel, value = training.step(e, pairs, nodes, rel, decoder, rate=0.1, dense=rule, number=step)
        nodes, rel = (spark.createDataFrame(t.toPandas()) for t in (new, new_rel))
        values.append(value)
    assert values[-1] < 0.9 * values[0]


def test_generator_step(spark):
    rng = np.random.default_rng(6)
    x, r, y = rng.normal(size=(5, 4)), rng.normal(size=(2, 4)), rng.normal(size=(5, 4))
    e = spark.createDataFrame([(0, 0, 0, 1), (1, 2, 1, 3)], "edge_id bigint, src bigint, rel bigint, dst bigint")
    pairs = spark.createDataFrame([(0, 3), (0, 4), (1, 0), (1, 4), (1, 1)], "edge_id bigint, neg bigint")
    got, value = training.generator_step(e, pairs, table(spark, "node_id", x), table(spark, "rel", r), table(spark, "node_id", y, state=0.1))
    src, neg, owner = np.array([0, 2]), np.array([3, 4, 0, 4, 1]), np.array([0, 0, 1, 1, 1])
    reward = 2 * (1 / (1 + np.exp(-((x[src] * r)[owner] * x[neg]).sum(axis=1))) - 0.5)

    def loss(y):
        return training.generator_slopes((y[src][owner] * y[neg]).sum(axis=1), reward, owner, 2)[0].mean()

    g = np.zeros_like(y)
    for i in np.ndindex(y.shape):
        d = np.zeros_like(y)
        d[i] = 1e-6
        g[i] = (loss(y + d) - loss(y - d)) / 2e-6
    assert value == pytest.approx(loss(y))
    assert np.array([q.x for q in got.orderBy("node_id").collect()]) == pytest.approx(y - 0.1 * g / np.sqrt(0.1 + g * g), abs=1e-5)
    lists = training.resident_local(*[spark.createDataFrame([(k, [1.0])], "node_id bigint, g array<double>") for k in (1, 2, 1)])
    assert {q.node_id: q.g for q in optim.reduce_gradients(lists, 1).collect()} == {1: [2.0], 2: [1.0]}


def test_a_loss_of_ones_own(spark):
    def hinge(pos, neg, owner):
        over = np.maximum(neg - pos[owner] + 1, 0)
        slope = (over > 0).astype(float)
        return np.bincount(owner, weights=over, minlength=len(pos)), -np.bincount(owner, weights=slope, minlength=len(pos)), slope

    e = spark.createDataFrame([(0, 0, 0, 1)], "edge_id bigint, src bigint, rel bigint, dst bigint")
    x, r = np.eye(3)[:, :3] + 0.5, np.ones((1, 3))
    rel = optim.DenseRule().start(table(spark, "rel", r))
    args = (e, spark.createDataFrame([(0, 2)], "edge_id bigint, neg bigint"), table(spark, "node_id", x, state=0.1), rel)
    own = training.step(*args, "distmult", hinge)
    same = training.step(*args, "distmult", "ranking", margin=1.0)
    assert own[2] == pytest.approx(same[2]) and sorted(own[0].collect()) == sorted(same[0].collect())
