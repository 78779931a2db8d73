"""Empty tables, nulls, repeated edges and extra columns through the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import analyze, checks, gnn, graph, ids, negatives, optim, partition, scoring, training

EDGE = "edge_id bigint, src bigint, rel int, dst bigint, note string"
ROWS = [(0, 0, 0, 1, "a"), (1, 0, 0, 1, "b"), (2, None, 0, 1, "c"), (3, 2, None, 0, None), (4, 1, 1, None, "e"), (5, 3, 1, 3, "f")]


@pytest.fixture(scope="module")
def e(spark):
    return spark.createDataFrame(ROWS, EDGE).cache()


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "node_id bigint, x array<double>").cache()


def vectors(x):
    return x.select(F.col("node_id").alias("vec_id"), F.col("x").alias("embedding"))


def test_degrees_and_neighbours(e):
    got = {r.node_id: (r.out_degree, r.in_degree) for r in graph.degrees(e).collect()}
    assert got == {0: (2, 1), 1: (1, 3), 2: (1, 0), 3: (1, 1), None: (1, 1)}
    hops = graph.khop(e.select(F.lit(0).cast("bigint").alias("node_id")), e, 2).collect()
    assert {(r.hop, r.node_id) for r in hops if r.node_id is not None} == {(0, 0), (1, 1), (1, 2)}
    assert graph.degrees(e.limit(0)).count() == 0


def test_ids(e):
    mapping = ids.encode_nodes(e)
    assert sorted(r.mapped_id for r in mapping.collect()) == [0, 1, 2, 3]
    mapped = ids.apply_mapping(e, mapping, ("src", "dst"))
    assert mapped.columns == e.columns and mapped.count() == 6 and mapped.filter("src IS NULL").count() == 1
    assert ids.encode_nodes(e.limit(0)).count() == 0 and ids.top_degree(e.limit(0), 3).count() == 0


def test_partitions(e):
    sizes = partition.bucket_sizes(e, 4, 2)
    assert sizes.count() == 4 and sizes.agg(F.sum("edges")).first()[0] == 4
    assert partition.bucket_sizes(e.limit(0), 4, 2).agg(F.sum("edges")).first()[0] == 0
    assert partition.split(e, (0.5, 0.5)).count() == 6 and partition.split(e.limit(0), (0.9, 0.05, 0.05)).count() == 0
    assert {r.place for r in partition.shuffled_rank(e, 1).collect()} == set(range(6))
    rows = partition.with_buckets(e, 4, 2)
    for f in (lambda t: partition.ordered_in_bucket(t, "src"), lambda t: partition.shuffled_in_bucket(t, 1), lambda t: partition.bucket_slices(t, 2, 1)):
        assert f(rows).count() == 6 and f(rows.limit(0)).count() == 0
    merged = partition.merge_sorted(e.filter("edge_id < 3"), e.filter("edge_id >= 3"), "src")
    assert {r.place for r in merged.collect()} == set(range(6)) and merged.filter("src IS NULL").first().place == 0
    assert partition.merge_sorted(e.limit(0), e.limit(0), "src").count() == 0


def test_negatives_and_scores(e, x):
    c = negatives.chunk_edges(e, 4, 2)
    neg = negatives.mixed(c, 4, 0.5, 4)
    rel = vectors(x).filter("vec_id < 2")
    scored = scoring.score_negatives(c, neg, vectors(x), rel)
    assert {r.edge_id for r in scored.collect()} <= {0, 1, 5}
    assert {r.edge_id for r in scoring.filtered_rank(scored, e).collect()} == {r.edge_id for r in scored.collect()}
    assert scoring.all_node_ranks(e, vectors(x), rel).count() == 3
    none = c.limit(0)
    empty = scoring.score_negatives(none, negatives.mixed(none, 4, 0.5, 4), vectors(x), rel)
    assert empty.count() == 0 and scoring.rank(empty).count() == 0 and scoring.losses(empty).count() == 0
    assert scoring.metrics(scoring.rank(empty)).first().n == 0
    assert scoring.score_negatives(c, neg, vectors(x).limit(0), rel).count() == 0
    assert scoring.all_node_ranks(e, vectors(x).limit(0), rel).count() == 0 and scoring.all_node_ranks(none, vectors(x), rel).count() == 0
    assert negatives.degree_global(none, graph.degrees(none), 3).count() == 0
    assert negatives.degree_in_batch(c, 3, exclude_chunk=True).count() == 3 * c.select("batch_id", "chunk").distinct().count()


def test_layers(e, x):
    w = np.ones((2, 2))
    some = e.na.fill(0, ["rel"])
    for f in (lambda e: gnn.sage(e, x, 2, w, w), lambda e: gnn.sage(e, x, 2, w, kind="gcn"), lambda e: gnn.gcn(e, x, 2, w), lambda e: gnn.gat(e, x, 2, [(w, np.ones(2), np.ones(2))]), lambda e: gnn.rgcn(e, x, 2, {0: w, 1: w}, w)):
        for edges in (some, some.limit(0)):
            assert {r.node_id for r in f(edges).collect()} >= {0, 1, 2, 3}
    with pytest.raises(Exception):
        gnn.rgcn(some, x, 2, {0: w}, w).collect()
    assert gnn.vector_max(gnn.messages(e.limit(0), x), ["node_id"], "x", 2).count() == 0


def test_updates(spark, e, x):
    t = x.withColumn("state", F.array_repeat(F.lit(0.1), 2))
    g = spark.createDataFrame([], "node_id bigint, g array<double>")
    assert sorted(optim.adagrad(t, g, 2, 0.1).select("node_id", "x").collect()) == sorted(x.collect())
    assert optim.scatter_add(x, g, 2).count() == 4
    rule = optim.DenseRule()
    rel = rule.start(spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 2.0])], "rel bigint, x array<double>"))
    pairs = spark.createDataFrame([(0, 3), (2, 0), (5, None)], "edge_id bigint, neg bigint")
    new, new_rel, value = training.step(e, pairs, t, rel, dense=rule)
    assert new.count() == 4 and new_rel.count() == 2 and value == value
    new, _, value = training.step(e.limit(0), pairs.limit(0), t, rel, dense=rule)
    assert value == 0 and sorted(new.select("node_id", "x").collect()) == sorted(x.collect())


def test_analyzers_and_checks(e):
    b = partition.batches(e, 4)
    assert analyze.batch_touches(b).agg(F.sum("touches")).first()[0] == 12
    assert analyze.batch_touches(b.limit(0)).count() == 0
    counts = analyze.access_counts(b, "batch_id")
    assert analyze.top_k_coverage(counts, 2, "batch_id").count() == 2 and analyze.top_k_coverage(counts.limit(0), 2, "batch_id").count() == 0
    assert analyze.smallest_hashes(b, "batch_id", 4).filter("hash IS NOT NULL").count() > 0
    assert {r["rule"]: r.bad for r in checks.violations(e, {"src": checks.not_null("src"), "range": checks.in_range("dst", 0, 3)}).collect()} == {"src": 1, "range": 1}
    assert checks.violations(e.limit(0), {"src": checks.not_null("src")}).first().bad == 0
