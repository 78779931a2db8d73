"""Small cases with known answers: missing vectors, masked negatives, saturated scores, large ids, hubs, all decoders."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions.ranking import number_in_groups
from edgeloom.operators import graph, negatives, partition, scoring

EDGE = "edge_id bigint, batch_id bigint, chunk bigint, src bigint, rel int, dst bigint"


def vectors(spark, ids, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)]) for i in ids], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
def test_both_ways_of_scoring_leave_out_the_same_rows(spark, decoder):
    nodes, rels = vectors(spark, [4, 0, 2]), vectors(spark, [0, 1], seed=1)
    edges = spark.createDataFrame([(0, 0, 0, 0, 0, 2), (1, 0, 0, 1, 0, 2), (2, 0, 0, 0, 1, 9), (3, 0, 1, 2, 0, 4), (4, 0, 1, None, 0, 4), (5, 0, 1, 4, 7, 0), (6, 0, 1, 4, None, 0), (7, 0, 2, 0, 0, 2)], EDGE)
    neg = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 1, 4), (0, 0, 2, None), (0, 0, 3, 99), (0, 1, 0, 0), (0, 1, 1, -5), (0, 2, 0, 3)], "batch_id bigint, chunk bigint, pos int, neg bigint")
    rows = []
    for way in (scoring._by_join, scoring._by_matrix):
        got = way(edges, neg, nodes, rels, decoder)
        rows.append((got.dtypes, {(r.edge_id, r.src, r.rel, r.pos, r.neg): (round(r.pos_score, 9), round(r.score, 9)) for r in got.collect()}))
    assert rows[0] == rows[1] and set(rows[0][1]) == {(0, 0, 0, 1, 4), (3, 2, 0, 0, 0)}
    for way in (scoring._by_join, scoring._by_matrix):
        assert way(edges.limit(0), neg, nodes, rels, decoder).count() == 0


def test_an_edge_whose_negatives_are_all_known_ranks_first(spark):
    scored = spark.createDataFrame([(0, 5, 0, 0, 7, 0.5, 0.9), (0, 5, 0, 1, 8, 0.5, 0.1), (1, 6, 0, 0, 7, 0.5, 0.9)], "edge_id bigint, src bigint, rel int, pos int, neg bigint, pos_score double, score double")
    known = spark.createDataFrame([(6, 0, 7), (5, 0, 8)], "src bigint, rel int, dst bigint")
    masked = negatives.mask_known(scored, known)
    assert {r.edge_id: r["rank"] for r in scoring.rank(masked).collect()} == {0: 2, 1: 1}
    assert negatives.filter_known(scored, known).count() == 1
    own = {r.edge_id: r for r in scoring.losses(masked).collect()}
    soft = lambda x: math.log1p(math.exp(x))
    assert own[1].softmax_ce == 0 and own[1].ranking == 0 and own[1].n == 1
    assert own[1].bce_logits == pytest.approx(soft(-0.5)) and own[1].mse == pytest.approx(0.25)
    assert own[0].bce_sigmoid == pytest.approx(soft(0.9) + soft(-0.5)) and own[0].n == 2
    assert scoring.top_k(masked, 2).count() == 1


def test_filtered_ranks_are_those_of_masked_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(e, e % 7, e % 3, p, int(rng.integers(20)), float(rng.integers(4)), float(rng.integers(4))) for e in range(60) for p in range(5)]
    positive = {e: s for e, *_, s, _ in rows}
    rows = [(e, s, r, p, n, positive[e], x) for e, s, r, p, n, _, x in rows]
    scored = spark.createDataFrame(rows, "edge_id bigint, src bigint, rel int, pos int, neg bigint, pos_score double, score double")
    known = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(7, size=150), rng.integers(3, size=150), rng.integers(20, size=150))], "src int, rel bigint, dst int")
    want = {r.edge_id: r["rank"] for r in scoring.rank(negatives.mask_known(scored, known)).collect()}
    assert {r.edge_id: r["rank"] for r in scoring.filtered_rank(scored, known).collect()} == want and 1 in want.values()
    assert scoring.filtered_rank(scored.limit(0), known).count() == 0
    with pytest.raises(Exception):
        scoring.filtered_rank(scored.withColumn("score", F.lit(float("nan"))), known).collect()


def test_saturated_scores_lose_no_term(spark):
    rows = [(0, 0.5, 50.0), (0, 0.5, 0.0), (1, -800.0, 0.0), (2, 1.0, 900.0)]
    got = {r.edge_id: r for r in scoring.losses(spark.createDataFrame(rows, "edge_id bigint, pos_score double, score double")).collect()}
    assert got[0].bce_sigmoid == pytest.approx(50 + math.log(2) + math.log1p(math.exp(-0.5)))
    assert got[1].bce_sigmoid == pytest.approx(scoring.LOG_BOUND + math.log(2)) and got[1].bce_logits == pytest.approx(800 + math.log(2))
    assert got[2].softmax_ce == pytest.approx(899) and got[2].bce_sigmoid == pytest.approx(scoring.LOG_BOUND + math.log1p(math.exp(-1)))
    total = scoring.losses(spark.createDataFrame(rows, "edge_id bigint, pos_score double, score double"))
    assert scoring.reduced(total, "softplus", "mean").first().loss == pytest.approx(scoring.reduced(total, "softplus").first().loss / 7)
    with pytest.raises(Exception):
        scoring.rank(spark.createDataFrame([(0, 1.0, float("inf"))], "edge_id bigint, pos_score double, score double")).collect()


def test_cross_entropy(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 800.0], 1), ([0.0, 0.0], 0), ([0.0], 5)], "logits array<double>, label int")
    assert [r.loss for r in scoring.cross_entropy(rows).collect()] == [pytest.approx(798), pytest.approx(math.log(2)), None]


@pytest.mark.parametrize("decoder", list(scoring.DECODERS))
def test_ranks_against_all_nodes(spark, decoder, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 4 * 8 * 10)  # ten nodes a block
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 7)
    nodes, rels = vectors(spark, range(33)), vectors(spark, range(3), seed=1)
    edges = spark.createDataFrame([(k, k % 33, k % 3, (k * 7) % 35) for k in range(40)], "edge_id bigint, src bigint, rel int, dst bigint")
    m, r = (np.array([x.embedding for x in t.orderBy("vec_id").collect()]) for t in (nodes, rels))
    op, compare, sign = scoring.DECODERS[decoder]
    want = {}
    for k in range(40):
        s, p, t = k % 33, k % 3, (k * 7) % 35
        if t < 33:
            q = scoring._NUMPY[op](m[[s]], r[[p]])
            all_ = scoring._NUMPY[compare](np.repeat(q, 33, axis=0), m) * sign
            want[k] = 1 + sum(all_[j] >= all_[t] - 1e-9 * max(1, abs(all_[t])) for j in range(33) if j != t)
    assert {x.edge_id: x.rank_raw for x in scoring.all_node_ranks(edges, nodes, rels, decoder).collect()} == want


def test_draws_reach_large_ids(spark):
    edges = negatives.chunk_edges(spark.range(200).select(F.col("id").alias("edge_id"), F.col("id").alias("src"), F.col("id").alias("dst")), 10, 2)
    n = 6_000_000_000
    drawn = [r.neg for r in negatives.uniform(edges, 100, n).collect()]
    assert max(drawn) > 0.99 * n and abs(np.mean(drawn) / n - 0.5) < 0.02
    degrees = spark.createDataFrame([(0, 3_000_000_000, 0), (1, 0, 3_000_000_000)], "node_id bigint, out_degree bigint, in_degree bigint")
    hits = Counter(r.neg for r in negatives.degree_global(edges, degrees, 100).collect())
    assert sum(hits.values()) == 4000 and abs(hits[0] - 2000) < 200
    far = edges.withColumn("batch_id", F.col("batch_id") + (1 << 40))
    one = {(r.batch_id, r.neg) for r in negatives.uniform(far, 5, n).collect()}
    assert len({x for _, x in one}) > 190  # batches whose numbers agree in their low bits have draws of their own
    with pytest.raises(ValueError):
        negatives.chunk_edges(edges, 10, negatives.CHUNKS + 1)


def test_qualified_candidates_are_known_only_with_their_qualifiers(spark):
    pairs = spark.createDataFrame([(0, 1, 0, 9, 5), (1, 1, 0, 9, 6), (2, 1, 0, 9, None)], "edge_id bigint, src bigint, rel int, neg bigint, qval bigint")
    known = spark.createDataFrame([(1, 0, 9, 5)], "src bigint, rel int, dst bigint, qval bigint")
    assert {r.edge_id for r in negatives.filter_known(pairs, known, qualifiers=("qval",)).collect()} == {1, 2}
    assert negatives.filter_known(pairs, known).count() == 0


def test_numbers_inside_groups(spark, monkeypatch):
    monkeypatch.setattr(partition, "SLICE_ROWS", 10)
    e = spark.range(500).select(F.col("id").alias("edge_id"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).alias("src"), F.lit(1).alias("rel"), (F.col("id") % 2).alias("dst_part"))
    e = e.withColumn("src_part", F.when(F.col("edge_id") % 5 == 0, None).otherwise(0))  # null is a group too
    rows = partition.ordered_in_bucket(e, "src").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.src_part, r.dst_part), []).append(r)
    assert len(rows) == 500
    for g in groups.values():
        assert [r.place for r in sorted(g, key=lambda r: (r.src, r.edge_id))] == list(range(len(g)))
    merged = partition.merge_sorted(e.filter("edge_id % 7 > 0"), e.filter("edge_id % 7 = 0"), "src").collect()
    assert [r.place for r in sorted(merged, key=lambda r: (r.src, r.added, r.edge_id))] == list(range(500))
    assert number_in_groups(e.limit(0), ["src"], {"x": F.col("dst_part")}, ["edge_id"], "n").count() == 0
    kept = partition.every_nth(e.filter("src_part = 0"), 8).count()
    assert kept == sum(-(-len(g) // 8) for k, g in groups.items() if k[0] == 0)


def test_hops_by_batch_and_hub_samples(spark, monkeypatch):
    monkeypatch.setattr(graph, "PARTS", 4)
    e = spark.createDataFrame([(i, 0, 0, i + 1) for i in range(60)] + [(60, 5, 0, 100), (61, 100, 0, 101)], "edge_id bigint, src bigint, rel int, dst bigint")
    seeds = spark.createDataFrame([(0, 0), (1, 100), (1, 100)], "batch_id bigint, node_id bigint")
    got = {(r.batch_id, r.node_id): r.hop for r in graph.khop(seeds, e, 2, by=("batch_id",)).collect()}
    assert got[(0, 0)] == 0 and got[(0, 60)] == 1 and got[(0, 100)] == 2 and got[(1, 100)] == 0 and got[(1, 101)] == got[(1, 5)] == 1 and got[(1, 0)] == 2
    assert (0, 101) not in got and (1, 7) not in got
    some = graph.khop(seeds.limit(1), e, 1, "uniform", limit=5).collect()
    assert len(some) == 6
    assert graph.khop(seeds.limit(0), e, 2).count() == 0
