"""Edges meet vectors without being shuffled with them, and whatever the way, the rows are the same."""

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from edgeloom.functions import keyfilter
from edgeloom.operators import negatives, scoring, training
from edgeloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def assert_no_vectors_move(df):
    """No node table is in the plan: neither edges with vectors nor vectors for edges are shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "mapinarrow" in plan.lower() and "embedding" not in plan, plan


def tables(spark, dim=4, odd=False):
    rng = np.random.default_rng(3)
    x = [(i, rng.normal(size=dim).tolist()) for i in range(12) if i != 5]
    nodes = spark.createDataFrame(x + [(20, None)] * odd, "vec_id bigint, embedding array<double>")
    return nodes, nodes.filter("vec_id < 3").select(F.col("vec_id").cast("int").alias("vec_id"), "embedding")


def odd_edges(spark):
    """Known, unknown and null ids, and an edge twice."""
    rows = [(0, 0, 0, 1, 2), (1, 1, 2, 3, 4), (2, 5, 0, 1, 2), (3, 1, 7, 2, 2), (4, None, 0, 1, 2), (5, 1, 0, 2, None), (6, 11, 1, 11, 11), (6, 11, 1, 11, 11), (7, 2, 1, 99, 3)]
    return spark.createDataFrame(rows, "edge_id bigint, src bigint, rel int, dst bigint, qval bigint")


def same_rows(a, b):
    """Rows but for the last places of their score."""
    a, b = (sorted((tuple(r)[:-1], r.score) for r in x) for x in (a, b))
    assert [k for k, _ in a] == [k for k, _ in b] and [v for _, v in a] == pytest.approx([v for _, v in b])


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
def test_edge_scores_joined_or_not(spark, monkeypatch, decoder):
    nodes, rel = tables(spark)
    run = lambda: scoring.edge_scores(odd_edges(spark), nodes, rel, decoder, qualifier="qval").collect()
    got = run()
    assert sorted(r.edge_id for r in got) == [0, 1, 6, 6]
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 0)
    same_rows(got, run())


def test_irregular_tables_are_joined(spark):
    nodes, rel = tables(spark, odd=True)
    assert not scoring.regular(nodes, rel) and scoring.regular(nodes.filter("vec_id < 20"), rel)
    twice = nodes.filter("vec_id < 20").union(nodes.filter("vec_id = 1"))
    assert not scoring.regular(twice, rel)
    e = spark.createDataFrame([(0, 20, 0, 1), (1, 0, 0, 1)], "edge_id bigint, src bigint, rel int, dst bigint")
    got = {r.edge_id: r.score for r in scoring.edge_scores(e, nodes, rel).collect()}
    assert got[0] is None and got[1] is not None
    assert scoring.edge_scores(e, twice, rel).filter("edge_id = 1").count() == 2


def test_score_qualified_moves_no_vectors(spark):
    assert_no_vectors_move(catalog.QUERIES["score_qualified"](spark, FOLDER))


def test_score_relation_corruption_moves_no_vectors(spark, monkeypatch):
    assert_no_vectors_move(catalog.QUERIES["score_relation_corruption"](spark, FOLDER))
    nodes, rel = tables(spark)
    e = odd_edges(spark).select("edge_id", "src", "dst", F.lit(0).alias("pos"), F.col("rel").alias("neg_rel"))
    got = scoring.relation_scores(e, nodes, rel).collect()
    assert sorted(r.edge_id for r in got) == [0, 1, 5, 6, 6]
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 0)
    same_rows(got, scoring.relation_scores(e, nodes, rel).collect())


@pytest.mark.parametrize("four", [False, True])
def test_tucker_projects_nodes_once(spark, monkeypatch, four):
    assert_no_vectors_move(catalog.QUERIES[f"score_tucker{3 + four}"](spark, FOLDER))
    nodes, rel = tables(spark)
    rng = np.random.default_rng(4)
    core, a, b = rng.normal(size=(3, 2, 3, *[2] * four, 3)), rng.normal(size=(4, 3)), rng.normal(size=(4, 2))
    e = odd_edges(spark).withColumn("qrel", F.col("qval") % 3)
    run = lambda: scoring.tucker_edges(e, nodes, rel, core, a, b).collect()
    got = run()
    assert sorted(r.edge_id for r in got) == [0, 1, 6, 6]
    whole = e
    for c, t in (("src", nodes), ("rel", rel), ("qrel", rel), ("qval", nodes), ("dst", nodes)):
        whole = scoring.lookup(whole, t, c, f"{c}_e")
    same_rows(got, scoring.tucker_qualified(whole, core, a, b).select(*e.columns, "score").collect())
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 0)
    same_rows(got, run())


def summed(parts):
    out = {}
    for r in parts.collect():
        out[r.kind, r.id] = out.get((r.kind, r.id), 0) + np.array(r.g)
    return out


@pytest.mark.parametrize("decoder", ["distmult", "l2", "complex"])
def test_gradients_joined_or_not(spark, monkeypatch, decoder):
    nodes, rel = tables(spark)
    args = nodes.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("x")), rel.select(F.col("vec_id").alias("rel"), F.col("embedding").alias("x"))
    e = odd_edges(spark).filter("edge_id <> 6 OR src = 1").union(spark.createDataFrame([(8, 1, 0, 2, 0), (9, 3, 1, 1, 0)], "edge_id bigint, src bigint, rel int, dst bigint, qval bigint"))
    e = e.withColumn("neg", F.when(F.col("edge_id") == 9, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(2), F.lit(5), F.lit(None), F.col("edge_id"), F.lit(2)).cast("array<bigint>")))
    pairs = e.select("edge_id", F.explode("neg").alias("neg"))
    got = [summed(training.gradients(e, None, *args, decoder)), summed(training.gradients(e, pairs, *args, decoder))]
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 0)
    got.append(summed(training.gradients(e, None, *args, decoder)))
    assert got[0][2, 0][1] == 5 and got[0].keys() == got[1].keys() == got[2].keys()
    assert all(np.allclose(got[0][k], g[k]) for g in got[1:] for k in g)


def test_gradient_sums_do_not_grow_with_edges(spark):
    """Many batches of one task emit one vector for each node."""
    nodes, rel = tables(spark)
    e = spark.range(40_000, numPartitions=20).selectExpr("id AS edge_id", "id % 4 AS src", "CAST(id % 3 AS int) AS rel", "id % 3 AS dst", "array(id % 4) AS neg")
    x = nodes.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("x"))
    parts = training.gradients(e, None, x, rel.select(F.col("vec_id").alias("rel"), F.col("embedding").alias("x")))
    assert parts.filter("kind = 0").count() <= 4 * spark.sparkContext.defaultParallelism
    assert summed(parts)[2, 0][1:].tolist() == [40_000, 40_000]


def test_gathered_negatives_shuffled_or_not(spark, monkeypatch):
    e = negatives.chunk_edges(odd_edges(spark).filter("edge_id <> 6"), 4, 2).select("edge_id", "batch_id", "chunk")
    neg = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 0, 8), (0, 1, 0, None), (1, 0, 0, 9)], "batch_id bigint, chunk bigint, pos int, neg bigint")
    want = {0: [8, 7], 1: [8, 7], 2: [], 3: [], 4: [9], 5: [9], 7: []}
    for bytes_ in (negatives.GATHER_BYTES, 0):
        monkeypatch.setattr(negatives, "GATHER_BYTES", bytes_)
        assert {r.edge_id: r.neg for r in negatives.gathered(e, neg).collect()} == want


def test_wide_filter_loses_no_key(spark):
    keys = spark.range(3000).selectExpr("id AS a", "-id * 5000000000 AS b")
    held = keyfilter.wide_filter(keys)
    a = np.arange(3000)
    assert keyfilter.wide_maybe(held, [a, -a * 5000000000]).all()
    assert keyfilter.wide_maybe(held, [a, -a * 5000000000 - 1]).mean() < 0.05
    assert len(keyfilter.wide_filter(keys.limit(0))) == 1 << 13


@pytest.mark.parametrize("decoder", ["distmult", "transe", "complex"])
def test_both_side_ranks_are_those_of_all_scores(spark, monkeypatch, decoder):
    """With a filter so narrow that it tells little, with a wide one, and with joins."""
    nodes, rel = tables(spark)
    inverse = nodes.filter("vec_id BETWEEN 6 AND 8").select((F.col("vec_id") - 6).cast("int").alias("vec_id"), "embedding")
    rng = np.random.default_rng(5)
    rows = [(i, *map(int, (rng.integers(13), rng.integers(4), rng.integers(13)))) for i in range(300)]
    e = spark.createDataFrame(rows + [(300, None, 0, 1), (301, 1, None, 1)], "edge_id bigint, src bigint, rel int, dst bigint")
    e = negatives.chunk_edges(e, 50, 5)
    neg = negatives.uniform(e, 6, 13)
    want = scoring.rank(scoring.both_sides(e, neg, nodes, rel, inverse, decoder, e).withColumn("edge_id", F.struct("edge_id", "side")))
    want = sorted((r.edge_id.edge_id, r.edge_id.side, r["rank"]) for r in want.collect())
    assert len(want) > 200
    run = lambda: sorted(map(tuple, scoring.both_side_ranks(e, neg, nodes, rel, inverse, e, decoder).collect()))
    assert run() == want
    monkeypatch.setattr(keyfilter, "WIDE_BITS", 256)
    assert run() == want
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 0)
    assert run() == want


def test_both_side_ranks_move_few_candidates(spark):
    plan = catalog.QUERIES["lp_metrics_both_sides"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "pos_score" not in plan


def assert_in_blocks(spark, monkeypatch, name, bytes_):
    """With a node table of several blocks the query gives the rows of its SQL and still shuffles no vectors."""
    monkeypatch.setattr(scoring, "MATRIX_BYTES", bytes_)
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 1000)
    assert_no_vectors_move(catalog.QUERIES[name](spark, FOLDER))
    assert_same(spark, FOLDER, catalog.QUERIES[name], catalog.SQL[name])


def test_score_qualified_in_blocks(spark, monkeypatch):
    assert_in_blocks(spark, monkeypatch, "score_qualified", 1 << 16)


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
def test_edge_scores_in_blocks(spark, monkeypatch, decoder):
    """Known, unknown and null ids, edges twice, floats and doubles."""
    nodes, rel = tables(spark)
    floats = [t.withColumn("embedding", F.col("embedding").cast("array<float>")) for t in (nodes, rel)]
    run = lambda n, r: scoring.edge_scores(odd_edges(spark), n, r, decoder, qualifier="qval")
    want = [run(nodes, rel).collect(), run(*floats).collect()]
    monkeypatch.setattr(scoring, "MATRIX_BYTES", 100)
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 2)
    assert len(scoring.blocks_of(nodes)) > 2
    for w, t in zip(want, ((nodes, rel), floats)):
        got = run(*t)
        assert_no_vectors_move(got)
        same_rows(w, got.collect())


def test_score_relation_corruption_in_blocks(spark, monkeypatch):
    assert_in_blocks(spark, monkeypatch, "score_relation_corruption", 1 << 16)


def test_score_tucker3_in_blocks(spark, monkeypatch):
    assert_in_blocks(spark, monkeypatch, "score_tucker3", 1 << 12)


def test_score_tucker4_in_blocks(spark, monkeypatch):
    assert_in_blocks(spark, monkeypatch, "score_tucker4", 1 << 12)
