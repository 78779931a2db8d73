import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import vectors as V
from edgeloom.functions.hashing import M, h
from edgeloom.functions.ranking import by_hash, number_rows
from edgeloom.operators import gnn, graph, ids, negatives, optim, partition, scoring
from edgeloom.plans import schedule
from edgeloom.sources import readers, sinks


def edges_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id bigint, src bigint, rel int, dst bigint")


@pytest.fixture(scope="module")
def mini(spark):
    return edges_of(spark, [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 0, 3), (4, 1, 5), (0, 0, 1), (6, 1, 0), (6, 0, 1)])


def test_hash_is_a_permutation_with_ranks(spark):
    df = spark.range(5000).withColumn("k", h(3, "id"))
    assert df.select("k").distinct().count() == 5000
    out = sorted(number_rows(df, by_hash(F.col("k")), ["k"]).toPandas().row_id)
    assert out == list(range(5000))
    assert df.agg(F.max("k")).first()[0] < M


def test_ids_are_dense_and_strings_stay_joined(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("x", "q", "x")], "src string, rel string, dst string")
    m = ids.encode_nodes(e)
    assert sorted(r.mapped_id for r in m.collect()) == [0, 1, 2, 3]
    back = {r.mapped_id: r.raw_id for r in m.collect()}
    got = sorted((back[r.src], back[r.dst]) for r in ids.apply_mapping(e, m, ("src", "dst")).collect())
    assert got == [("a", "b"), ("b", "c"), ("x", "x")]


def test_buckets_with_a_short_last_partition(spark, mini):
    sizes = {(r.src_part, r.dst_part): r.edges for r in partition.bucket_sizes(mini, 7, 3).collect()}
    assert len(sizes) == 9 and sum(sizes.values()) == 8
    assert sizes[(0, 0)] == 4 and sizes[(2, 0)] == 2 and sizes[(0, 1)] == 0


def test_split_counts_and_disjointness(spark):
    e = edges_of(spark, [(i, 0, i + 1) for i in range(103)])
    got = {r["split"]: r["count"] for r in partition.split(e, (0.9, 0.05, 0.05)).groupBy("split").count().collect()}
    assert got == {"train": 92, "valid": 5, "test": 6}
    half = partition.split(e, (0.3, 0.1, 0.1)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in half} == {"train": 30, "valid": 10, "test": 11}
    assert partition.hold_out(e, 10).filter("held_out").count() == 10
    assert partition.split(e, (0.8, 0.2)).select("edge_id").distinct().count() == 103


def test_degrees_star_and_empty(spark):
    star = edges_of(spark, [(0, 0, i) for i in range(1, 11)])
    got = {r.node_id: (r.out_degree, r.in_degree) for r in graph.degrees(star).collect()}
    assert got[0] == (10, 0) and got[3] == (0, 1)
    assert graph.degrees(star.limit(0)).count() == 0


def test_last_chunk_is_short(spark):
    e = negatives.chunk_edges(edges_of(spark, [(i, 0, i) for i in range(7)]), 7, 3)
    assert [r["count"] for r in e.groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 1]
    out = negatives.degree_in_batch(e, 20, exclude_chunk=True).join(e.select("batch_id", F.col("batch_row").alias("sampled_row"), F.col("chunk").alias("own")), ["batch_id", "sampled_row"])
    assert out.filter("own = chunk").count() == 0 and out.count() == 60


def test_ties_count_against_the_positive(spark):
    s = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 1.0, 1.0), (0, 2, 1.0, 0.5)], "edge_id bigint, pos int, pos_score double, score double")
    assert scoring.rank(s).first()["rank"] == 3
    with pytest.raises(Exception, match="not finite"):
        scoring.rank(s.withColumn("score", F.lit(float("nan")))).collect()


def test_scores_by_hand(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.5, 1.0, -1.0, 2.0], [2.0, 0.0, 1.0, 1.0])], "s array<double>, r array<double>, t array<double>")
    s, r, t = (F.col(c) for c in "srt")
    one = lambda d: df.select(scoring.score(d, s, r, t)).first()[0]
    x, y, z = (np.array(v) for v in df.first())
    assert one("distmult") == pytest.approx((x * y * z).sum())
    assert one("transe") == pytest.approx(-np.sqrt(((x + y - z) ** 2).sum()))
    c = lambda v: v[:2] + 1j * v[2:]
    p = c(x) * c(y)
    assert one("complex") == pytest.approx(np.concatenate([p.real, p.imag]) @ z)
    assert one("cosine") == pytest.approx(x @ z / np.linalg.norm(x) / np.linalg.norm(z))
    assert df.select(V.cosine(s, F.array_repeat(F.lit(0.0), 4))).first()[0] == 0


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
def test_matrix_and_join_agree(spark, decoder):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i * 3, rng.normal(size=4).tolist()) for i in range(9)], "vec_id bigint, embedding array<double>")
    rels = nodes.filter("vec_id < 6").selectExpr("cast(vec_id as int) AS vec_id", "embedding")
    e = negatives.chunk_edges(edges_of(spark, [(3 * (i % 9), 3 * (i % 2), 3 * (i * i % 9)) for i in range(20)]), 10, 2).select("edge_id", "batch_id", "chunk", "src", "rel", "dst")
    neg = negatives.uniform(e, 3, 9).withColumn("neg", F.col("neg") * 3)
    rows = lambda f: {(r.edge_id, r.pos, r.neg): (r.pos_score, r.score) for r in f(e, neg, nodes, rels, decoder).collect()}
    a, b = rows(scoring._by_matrix), rows(scoring._by_join)
    assert a.keys() == b.keys() and len(a) == 60 and all(a[k] == pytest.approx(b[k]) for k in a)


def test_losses_by_hand(spark):
    s = spark.createDataFrame([(0, 2.0, 1.0), (0, 2.0, 2.5)], "edge_id bigint, pos_score double, score double")
    got = scoring.losses(s).first()
    assert got.softmax_ce == pytest.approx(math.log(math.exp(2) + math.exp(1) + math.exp(2.5)) - 2)
    assert got.ranking == pytest.approx(0.6)
    assert got.mse == pytest.approx(1 + 6.25 + 1)
    assert got.bce_logits == pytest.approx(got.bce_sigmoid)


def test_qualified_tucker_against_numpy(spark):
    rng = np.random.default_rng(2)
    for shape, given in (((3, 2, 3, 3), ["src", "rel", "qval", "dst"]), ((3, 2, 3, 2, 3), ["src", "rel", "qrel", "qval", "dst"])):
        core, a, b, x = rng.normal(size=shape), rng.normal(size=(7, 3)), rng.normal(size=(7, 2)), rng.normal(size=(len(given), 7))
        df = spark.createDataFrame([tuple(v.tolist() for v in x)], ", ".join(f"{n}_e array<double>" for n in given))
        inside = [v @ (b if n in ("rel", "qrel") else a) for n, v in zip(given[:-1], x)]
        want = np.einsum("pqrs,p,q,s->r" if core.ndim == 4 else "pqrst,p,q,s,t->r", core, *inside) @ a.T @ x[-1]
        assert scoring.tucker_qualified(df, core, a, b).first().score == pytest.approx(want)


def test_layers_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, dim = 6, 4
    pairs = [(0, 1), (1, 2), (2, 0), (3, 0), (4, 0), (0, 4)]
    e = edges_of(spark, [(a, 0, b) for a, b in pairs])
    x = rng.normal(size=(n, dim))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id bigint, x array<double>")
    w1, w2 = rng.normal(size=(2, dim)), rng.normal(size=(2, dim))
    out = lambda df: np.array([r.x for r in df.orderBy("node_id").collect()])
    nbrs = [[b for a, b in pairs if a == i] + [a for a, b in pairs if b == i] for i in range(n)]
    want = np.array([w1 @ x[i] + w2 @ (x[nbrs[i]].mean(axis=0) if nbrs[i] else np.zeros(dim)) for i in range(n)])
    assert out(gnn.sage(e, t, dim, w1, w2)) == pytest.approx(want)
    want = np.array([w1 @ ((x[nbrs[i]].sum(axis=0) + x[i]) / (len(nbrs[i]) + 1)) for i in range(n)])
    assert out(gnn.sage(e, t, dim, w1, kind="gcn")) == pytest.approx(want)
    a = np.eye(n)
    for s, d in pairs:
        a[d, s] += 1
    deg = a.sum(axis=1)
    want = (a / np.sqrt(deg[:, None] * deg[None])) @ x @ w1.T
    assert out(gnn.gcn(e, t, dim, w1)) == pytest.approx(want)
    z, u, v = x @ w1.T, rng.normal(size=2), rng.normal(size=2)
    rows = []
    for i in range(n):
        around = [s for s, d in pairs if d == i] + [i]
        g = np.array([z[i] @ u + z[j] @ v for j in around])
        g = np.where(g > 0, g, 0.2 * g)
        p = np.exp(g - g.max())
        rows.append((p / p.sum()) @ z[around])
    assert out(gnn.gat(e, t, dim, [(w1, u, v)])) == pytest.approx(np.array(rows))
    assert out(gnn.gat(e, t, dim, [(w1, u, v), (w1, u, v)])) == pytest.approx(np.concatenate([rows, rows], axis=1))
    assert out(gnn.gat(e, t, dim, [(w1, u, v), (2 * w1, u / 2, v / 2)], average=True)) == pytest.approx(1.5 * np.array(rows))


def test_adagrad_and_dense_optimisers(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0], [0.0, 0.0]), (1, [3.0, 4.0], [1.0, 1.0])], "node_id bigint, x array<double>, state array<double>")
    g = spark.createDataFrame([(0, [1.0, 2.0]), (0, [2.0, -2.0])], "node_id bigint, g array<double>")
    got = {r.node_id: r for r in optim.adagrad(t, g, 2, 0.1).collect()}
    assert got[0].x == pytest.approx([0.9, 2.0]) and got[0].state == [9.0, 0.0] and got[1].x == [3.0, 4.0]
    w = np.array([1.0])
    assert optim.Dense("sgd", 0.5).step(w, w) == pytest.approx([0.5])
    assert optim.Dense("adam", 0.1).step(w, w) == pytest.approx([0.9], abs=1e-6)


@pytest.mark.parametrize("parts", [4, 8, 16, 32])
def test_rounds_are_disjoint_and_complete(parts):
    rounds = schedule.disjoint_rounds(parts)
    assert all(sorted(p for s in r for p in s) == list(range(parts)) for r in rounds)
    assert len({c for r in rounds for s in r for c in combinations(sorted(s), 2)}) == parts * (parts - 1) // 2
    if parts == 16:
        assert len(rounds) == 5 and sum(map(len, rounds)) == 20
    assert schedule.relabelled(rounds, 1) != rounds or parts == 4


def test_orderings():
    states = schedule.swap_ordering(9, 4)
    assert len({c for s in states for c in combinations(sorted(s), 2)}) == 36
    assert all(len(set(a) ^ set(b)) == 2 for a, b in zip(states, states[1:]))
    flat = [s for r in schedule.disjoint_rounds(16) for s in r]
    mixed = flat[::5] + flat[1::5] + flat[2::5] + flat[3::5] + flat[4::5]
    again = schedule.group_disjoint(mixed, 4)
    assert all(len({p for s in again[i : i + 4] for p in s}) == 16 for i in range(0, 20, 4))
    sizes = [[(a * 7 + b * 13) % 50 for b in range(16)] for a in range(16)]
    assert schedule.round_cost(schedule.balanced(schedule.disjoint_rounds(16), sizes), sizes) < schedule.round_cost(schedule.disjoint_rounds(16), sizes)


def test_read_write_and_checkpoint(spark, tmp_path, mini):
    f = tmp_path / "e.tsv"
    f.write_text("h1\nh2\na\tb\tr\nc\td\tq\n")
    got = readers.read_edges(spark, str(f), [0, 2, 1], header_lines=2).collect()
    assert [(r.src, r.rel, r.dst) for r in got] == [("a", "r", "b"), ("c", "q", "d")]
    with pytest.raises(ValueError):
        readers.read_edges(spark, str(f), [0])
    out = str(tmp_path / "set")
    sinks.write_dataset(out, {"train": mini}, 7, 3)
    assert sinks.read_bucket(spark, out, "train", 0, 0).count() == 4
    c = sinks.write_checkpoint(str(tmp_path), 1, {"x": mini}, {"epoch": 1})
    tables, meta = sinks.read_checkpoint(spark, c, ["x"])
    assert tables["x"].count() == 8 and meta == {"epoch": 1}


def test_stream_and_batch_agree(spark, tmp_path):
    from edgeloom.streaming.events import windowed_counts

    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(src).write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, windowed_counts(spark.read.parquet(src)).collect()))
