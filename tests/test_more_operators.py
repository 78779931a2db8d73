import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import analyze, checks, gnn, negatives, partition, scoring


def edges_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id bigint, src bigint, rel int, dst bigint")


def test_checks_count_and_raise(spark):
    df = spark.createDataFrame([(1.0, 5), (float("nan"), -1), (None, None)], "x double, i int")
    rules = {"nan": checks.not_nan("x"), "null": checks.not_null("i"), "negative": checks.not_negative("i"), "range": checks.in_range("i", 0, 5)}
    assert {r.rule: r.bad for r in checks.violations(df, rules).collect()} == {"nan": 1, "null": 1, "negative": 1, "range": 2}
    with pytest.raises(ValueError, match="nan"):
        checks.require(df, rules)
    assert {r.bad for r in checks.violations(df.limit(0), rules).collect()} == {0}
    assert checks.require(df.limit(0), rules).count() == 0


def test_merge_keeps_order_and_puts_base_first(spark):
    base, delta = edges_of(spark, [(0, 0, 1), (2, 0, 1), (2, 0, 3)]), edges_of(spark, [(2, 0, 9), (1, 0, 9)])
    got = [(r.src, r.added) for r in partition.merge_sorted(base, delta, "src").orderBy("place").collect()]
    assert got == [(0, 0), (1, 1), (2, 0), (2, 0), (2, 1)]
    assert partition.merge_sorted(base.limit(0), delta.limit(0), "src").count() == 0


def test_both_sides_of_one_edge(spark):
    nodes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])], "vec_id bigint, embedding array<double>")
    rel = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id int, embedding array<double>")
    inverse = spark.createDataFrame([(0, [3.0, 5.0])], "vec_id int, embedding array<double>")
    e = negatives.chunk_edges(edges_of(spark, [(0, 0, 1)]), 1, 1)
    neg = spark.createDataFrame([(0, 0, 0, 2)], "batch_id bigint, chunk bigint, pos int, neg bigint")
    got = {r.side: (r.pos_score, r.score) for r in scoring.both_sides(e, neg, nodes, rel, inverse).collect()}
    assert got == {"dst": (0.0, 2.0), "src": (0.0, 10.0)}
    assert scoring.pooled_metrics(scoring.both_sides(e, neg, nodes, rel, inverse)).first()["mean_rank"] == 2.0
    assert [(r.src, r.dst) for r in negatives.reversed_edges(e).collect()] == [(1, 0)]


def test_norms_by_hand(spark):
    t = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<double>")
    assert tuple(scoring.norms(t, coefficient=0.1).first()) == (2, 0.25, 2.5)
    assert scoring.norms(t, p=1).first()["mean_norm"] == 3.5


def test_stack_of_layers_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=(3, 2))
    w, v = np.random.default_rng(2).normal(size=(2, 2, 2))
    table = spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "node_id bigint, x array<double>")
    e = edges_of(spark, [(0, 0, 1), (0, 0, 1), (1, 0, 1)])
    layer = lambda edges, t: gnn.sage(edges, t, 2, w, v)
    got = {r.node_id: r.x for r in gnn.encode(e, table, [(layer, np.array([0.1, -0.1]), "relu"), (layer, None, "none")]).collect()}

    def plain(x):
        means = np.array([x[1], (2 * x[0] + 2 * x[1]) / 4, [0, 0]])
        return x @ w.T + means @ v.T

    want = plain(np.maximum(plain(x) + [0.1, -0.1], 0))
    assert np.allclose([got[i] for i in range(3)], want)


def test_moves_of_a_lane(spark):
    s = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 2), (0, 1, 3)], "lane int, superstep bigint, part int")
    got = {(r.superstep, r.part, r.move) for r in analyze.lane_moves(s).collect()}
    assert got == {(0, 1, "admit"), (0, 2, "admit"), (1, 3, "admit"), (1, 1, "evict")}


def test_sketch_is_exact_when_small_and_near_when_large(spark):
    small = spark.range(20).select(F.lit(0).alias("g"), F.col("id").alias("src"), F.col("id").alias("dst"))
    large = spark.range(20000).select(F.lit(0).alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    est = lambda e: analyze.estimate_distinct(analyze.smallest_hashes(e, "g", 256), "g", 256).first()["estimate"]
    assert est(small) == 20.0
    assert abs(est(large) / 20001 - 1) < 0.25
    halves = analyze.smallest_hashes(large.filter("src < 10000"), "g", 256).unionByName(analyze.smallest_hashes(large.filter("src >= 10000"), "g", 256))
    assert analyze.estimate_distinct(analyze.merge_sketches(halves, "g", 256), "g", 256).first()["estimate"] == est(large)


def test_logs_and_node_tables(spark, tmp_path):
    from edgeloom.sources import readers, sinks

    (tmp_path / "a.log").write_text("MRR: 0.1\nHits@10: 0.2\nnoise\nMRR: 0.35\nHits@10: 0.5\n")
    (tmp_path / "n.csv").write_text("a,3,0.5,1.5\nb,nan,1,2\nc,,1,2\nd\n")
    row = readers.read_eval_log(spark, str(tmp_path / "a.log")).first()
    assert (row.mrr, row.hits) == (0.35, 0.5)
    got = {r.raw_id: (r.label, r.features) for r in readers.read_node_table(spark, str(tmp_path / "n.csv")).collect()}
    assert got == {"a": (3, [0.5, 1.5]), "b": (-1, [1.0, 2.0]), "c": (-1, [1.0, 2.0]), "d": (-1, [])}
    x = spark.range(7).select(F.col("id").alias("node_id"), F.array(F.lit(1.0)).alias("x"))
    sinks.write_encoded(x, str(tmp_path / "enc"), 7, 3)
    assert {r.partition_id: r["count"] for r in spark.read.parquet(str(tmp_path / "enc")).groupBy("partition_id").count().collect()} == {0: 3, 1: 3, 2: 1}
    sinks.append_rows(x, str(tmp_path / "rows"))
    sinks.append_rows(x, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 14


def test_rgcn_rewards_and_theta_sketch(spark):
    x = np.random.default_rng(3).normal(size=(3, 2))
    w0, w1, own = np.random.default_rng(4).normal(size=(3, 2, 2))
    table = spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "node_id bigint, x array<double>")
    e = edges_of(spark, [(0, 0, 1), (0, 1, 2), (1, 1, 2)])
    got = {r.node_id: r.x for r in gnn.rgcn(e, table, 2, {0: w0, 1: w1}, own).collect()}
    want = x @ own.T + np.array([(w0 @ x[1] + w1 @ x[2]) / 2, w1 @ x[2], [0, 0]])
    assert np.allclose([got[i] for i in range(3)], want)

    s = np.array([0.5, -1.0, 2.0])
    row = scoring.gan_rewards(spark.createDataFrame([(0, float(v)) for v in s], "edge_id bigint, score double")).first()
    p, reward = np.exp(s) / np.exp(s).sum(), 2 * (1 / (1 + np.exp(-s)) - 0.5)
    assert np.allclose([row.loss, row.reward], [-(np.log(p) * reward * p).mean(), reward.mean()])

    few = spark.range(100).select(F.lit(0).alias("g"), F.col("id").alias("src"), F.col("id").alias("dst"))
    assert round(analyze.sketch_distinct(few, "g").first()["estimate"]) == 100


def test_a_sampled_encoding_of_all_neighbours_is_the_whole_one(spark):
    rng = np.random.default_rng(8)
    n = 12
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (15, 2))]
    e = spark.createDataFrame([(i, a, 0, b) for i, (a, b) in enumerate(pairs)], "edge_id bigint, src bigint, rel int, dst bigint")
    x = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n)], "node_id bigint, x array<double>")
    w = [rng.normal(size=(3, 3)) for _ in range(4)]
    layers = [(lambda e, x: gnn.sage(e, x, 3, w[0], w[1]), np.ones(3) * 0.1, "relu"), (lambda e, x: gnn.sage(e, x, 3, w[2], w[3]), None, "sigmoid")]
    seeds = spark.createDataFrame([(0,), (5,), (5,)], "node_id bigint")
    whole = {r.node_id: r.x for r in gnn.encode(e, x, layers).collect()}
    got = {r.node_id: r.x for r in gnn.encode_sampled(seeds, e, x, layers).collect()}
    assert set(got) == {0, 5} and all(np.allclose(got[i], whole[i]) for i in got)
    few = gnn.encode_sampled(seeds, e, x, layers, "uniform", limit=1).collect()
    assert {r.node_id for r in few} == {0, 5}
