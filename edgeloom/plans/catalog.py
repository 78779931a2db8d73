"""Named queries over the standard tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import vectors as V
from edgeloom.functions.hashing import M, draw_sql, h_numpy, h_sql
from edgeloom.functions.ranking import by_value, number_rows
from edgeloom.functions.work import materialise
from edgeloom.operators import analyze, checks, gnn, gnn_training, graph, ids, negatives, optim, partition, scoring, training
from edgeloom.plans import schedule
from edgeloom.streaming.events import windowed_counts

PARTS = 16
BATCH, CHUNKS, NEGATIVES = 1000, 10, 10
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql if not sql.lstrip().upper().startswith(("SELECT", "WITH")) else sql
        return f

    return add


# ---- views ------------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    t = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return t, t.count()


def relations(emb: DataFrame) -> DataFrame:
    return emb.filter("vec_id < 7").select(F.col("vec_id").cast("int").alias("vec_id"), "embedding")


def kg(spark: SparkSession, d: str, with_ids: bool = True) -> tuple[DataFrame, int]:
    """lineitem as a knowledge graph."""
    n = table(spark, d, "embeddings").count()
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    if with_ids:
        rows = number_rows(rows, by_value(rows, "l_orderkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "edge_id")
    keep = ["edge_id"] * with_ids
    return rows.select(*keep, (F.col("l_orderkey") % n).alias("src"), (F.col("l_linenumber") - 1).alias("rel"), (F.col("l_partkey") % n).alias("dst"), (F.col("l_suppkey") % n).alias("qval"), "l_returnflag"), n


KG = """n AS (SELECT count(*) AS n FROM embeddings),
kg AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS edge_id, l_orderkey % n AS src,
       l_linenumber - 1 AS rel, l_partkey % n AS dst, l_suppkey % n AS qval, l_returnflag FROM lineitem, n)"""
EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), rl AS (SELECT vec_id AS rel, e AS rv FROM emb WHERE vec_id < 7)"
PSIZE = f"(SELECT (n + {PARTS - 1}) // {PARTS} FROM n)"
BUCKETS = f"""bk AS (SELECT *, (src // {PSIZE})::INT AS src_part, (dst // {PSIZE})::INT AS dst_part FROM kg),
sizes AS (SELECT a.range::INT AS src_part, b.range::INT AS dst_part, count(bk.src) AS edges FROM range({PARTS}) a CROSS JOIN range({PARTS}) b
          LEFT JOIN bk ON bk.src_part = a.range AND bk.dst_part = b.range GROUP BY ALL)"""
CHUNKED = f"""ch AS (SELECT *, edge_id // {BATCH} AS batch_id, edge_id % {BATCH} AS batch_row, (edge_id % {BATCH}) // {-(-BATCH // CHUNKS)} AS chunk FROM kg),
plan AS (SELECT batch_id, chunk, pos.range AS pos FROM (SELECT DISTINCT batch_id, chunk FROM ch), range({NEGATIVES}) pos)"""
KEY = f"batch_id * {negatives.CHUNKS} + chunk"
HETERO = "het AS (SELECT 'o' || l_orderkey AS src, l_returnflag AS rel, 'p' || l_partkey AS dst, l_linestatus AS qrel, 's' || l_suppkey AS qval FROM lineitem)"
MAPPED = "raw AS (SELECT DISTINCT unnest([src, dst]) AS raw_id FROM het), map AS (SELECT raw_id, row_number() OVER (ORDER BY md5(raw_id), raw_id) - 1 AS mapped_id FROM raw)"


def hetero(spark: SparkSession, d: str) -> DataFrame:
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return table(spark, d, "lineitem").select(c("o", "l_orderkey").alias("src"), F.col("l_returnflag").alias("rel"), c("p", "l_partkey").alias("dst"), F.col("l_linestatus").alias("qrel"), c("s", "l_suppkey").alias("qval"))


def chunked(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Numbered edges in batches and chunks, written once: the queries read them several times."""
    edges, n = kg(spark, d)
    return materialise(negatives.chunk_edges(edges, BATCH, CHUNKS)), n


# ---- ids --------------------------------------------------------------------------------------------------------------


@query(f"{HETERO}, {MAPPED} SELECT raw_id, mapped_id FROM map")
def id_encode_nodes(spark, d):
    return ids.encode_nodes(hetero(spark, d))


@query(f"{HETERO}, {MAPPED} SELECT a.mapped_id AS src, b.mapped_id AS dst, count(*) AS n FROM het JOIN map a ON a.raw_id = src JOIN map b ON b.raw_id = dst GROUP BY ALL")
def id_encode_edges(spark, d):
    e = hetero(spark, d)
    return ids.apply_mapping(e.select("src", "dst"), ids.encode_nodes(e), ("src", "dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"{HETERO}, raw AS (SELECT DISTINCT unnest([rel, qrel]) AS raw_id FROM het) SELECT raw_id, row_number() OVER (ORDER BY md5(raw_id), raw_id) - 1 AS mapped_id FROM raw")
def rel_namespace_merge(spark, d):
    return ids.encode_relations(hetero(spark, d), ("rel", "qrel"))


@query(f"""{HETERO}, raw AS (SELECT DISTINCT unnest([src, dst]) AS raw_id FROM het), t AS (SELECT DISTINCT 'p' || p_partkey AS raw_id FROM part WHERE p_partkey % 3 = 0)
SELECT raw_id, row_number() OVER (ORDER BY t.raw_id IS NULL, md5(raw_id), raw_id) - 1 AS mapped_id FROM raw LEFT JOIN t USING (raw_id)""")
def seq_train_ids(spark, d):
    train = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("raw_id"))
    return ids.sequential_train_ids(hetero(spark, d), train)


@query(f"{HETERO} SELECT raw_id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS raw_id FROM het) GROUP BY ALL ORDER BY degree DESC, raw_id LIMIT 50")
def top_degree_ids(spark, d):
    return ids.top_degree(hetero(spark, d), 50)


@query(f"""{KG}, b AS (SELECT edge_id // {BATCH} AS batch_id, src, dst FROM kg), u AS (SELECT DISTINCT batch_id, unnest([src, dst]) AS node_id FROM b)
SELECT batch_id, node_id, row_number() OVER (PARTITION BY batch_id ORDER BY node_id) - 1 AS local_id FROM u""")
def batch_local_ids(spark, d):
    return ids.local_ids(partition.batches(kg(spark, d)[0], BATCH))


@query("SELECT vec_id AS mapped_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def node_remap_labels(spark, d):
    emb, _ = nodes(spark, d)
    mapping = emb.select(F.col("vec_id").cast("string").alias("raw_id"), F.col("vec_id").alias("mapped_id"))
    return ids.remap_nodes(emb.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("raw_id"), "label"), mapping, "label")


# ---- partitions -------------------------------------------------------------------------------------------------------


@query(f"{KG} SELECT (vec_id // {PSIZE})::INT AS part, count(*) AS nodes, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY ALL")
def node_partition(spark, d):
    emb, n = nodes(spark, d)
    return emb.groupBy(partition.partition_of("vec_id", n, PARTS).alias("part")).agg(F.count(F.lit(1)).alias("nodes"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query(f"{KG}, {BUCKETS} SELECT * FROM sizes")
def edge_bucket_sizes(spark, d):
    e, n = kg(spark, d, False)
    return partition.bucket_sizes(e, n, PARTS)


@query(f"""n AS (SELECT count(*) AS n FROM embeddings), pm AS (SELECT vec_id, row_number() OVER (ORDER BY {h_sql(7, "vec_id")}, vec_id) - 1 AS new_id FROM embeddings),
kg AS (SELECT a.new_id AS src, b.new_id AS dst FROM lineitem, n, pm a, pm b WHERE a.vec_id = l_orderkey % n AND b.vec_id = l_partkey % n), {BUCKETS} SELECT * FROM sizes""")
def bucket_rewrite_perm(spark, d):
    e, n = kg(spark, d, False)
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("edge_id"))
    perm = partition.shuffled_rank(emb, 7, "new_id").select(F.col("edge_id").alias("node_id"), "new_id")
    return partition.bucket_sizes(partition.permuted(e, perm), n, PARTS)


_PLACE = f"pl AS (SELECT edge_id, src, rel, dst, row_number() OVER (ORDER BY {h_sql(1, 'edge_id')}, edge_id) - 1 AS place, count(*) OVER () AS total FROM kg)"


@query(f"{KG}, {_PLACE} SELECT edge_id, CASE WHEN place < floor(total * 0.9) THEN 'train' WHEN place < floor(total * 0.9) + floor(total * 0.05) THEN 'valid' ELSE 'test' END AS split FROM pl")
def split_3way(spark, d):
    return partition.split(kg(spark, d)[0], (0.9, 0.05, 0.05)).select("edge_id", "split")


@query(f"{KG}, {_PLACE} SELECT split, count(*) AS n, sum(edge_id)::BIGINT AS ids FROM (SELECT edge_id, CASE WHEN place < floor(total * 0.8) THEN 'train' ELSE 'test' END AS split FROM pl) GROUP BY ALL")
def split_2way(spark, d):
    return partition.split(kg(spark, d)[0], (0.8, 0.2)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("edge_id").alias("ids"))


@query(f"{KG}, pl AS (SELECT edge_id, src, dst, row_number() OVER (ORDER BY {h_sql(12345, 'edge_id')}, edge_id) <= 1000 AS held_out FROM kg) SELECT edge_id, held_out FROM pl")
def holdout_k(spark, d):
    return partition.hold_out(kg(spark, d)[0], 1000).select("edge_id", "held_out")


@query(f"{KG} SELECT edge_id // {BATCH} AS batch_id, count(*) AS n, min(edge_id) AS first FROM kg GROUP BY ALL")
def batch_assign(spark, d):
    return partition.batches(kg(spark, d)[0], BATCH).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first"))


@query(f"""{KG}, {BUCKETS}, sl AS (SELECT edge_id, src_part, dst_part, (row_number() OVER (PARTITION BY src_part, dst_part ORDER BY edge_id) - 1) // 100 AS slice FROM bk)
SELECT src_part, dst_part, slice, {h_sql(3, "src_part * 65536 + dst_part", "slice")} AS slice_order, count(*) AS n, min(edge_id) AS first FROM sl GROUP BY ALL""")
def bucket_streaming_slices(spark, d):
    e, n = kg(spark, d)
    rows = partition.bucket_slices(partition.with_buckets(e, n, PARTS), 100, 3)
    return rows.groupBy("src_part", "dst_part", "slice", "slice_order").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first"))


@query(f"{KG} SELECT edge_id, row_number() OVER (ORDER BY {h_sql(9, 'edge_id')}, edge_id) - 1 AS place FROM kg")
def full_shuffle(spark, d):
    return partition.shuffled_rank(kg(spark, d)[0], 9).select("edge_id", "place")


# ---- degrees ----------------------------------------------------------------------------------------------------------


@query(f"{KG}, e AS (SELECT src AS node_id, 1 AS o, 0 AS i FROM kg UNION ALL SELECT dst, 0, 1 FROM kg) SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY ALL")
def degree_in_out(spark, d):
    return graph.degrees(kg(spark, d, False)[0])


@query(f"{KG}, {BUCKETS} SELECT p.range::INT AS part, sum(CASE WHEN src_part = p.range OR dst_part = p.range THEN edges ELSE 0 END)::BIGINT AS hotness FROM sizes, range({PARTS}) p GROUP BY ALL")
def partition_hotness(spark, d):
    e, n = kg(spark, d, False)
    return graph.partition_hotness(partition.bucket_sizes(e, n, PARTS))


# ---- negatives --------------------------------------------------------------------------------------------------------

_UNI = f"uni AS (SELECT batch_id, chunk, pos, {draw_sql(11, KEY, 'pos', 'SELECT n FROM n')} AS neg FROM plan)"
_DRAW = lambda n: draw_sql(12, KEY, "pos", n)
_DEG = f"""bs AS (SELECT batch_id, count(*) AS rows FROM ch GROUP BY ALL), sp AS (SELECT batch_id, chunk, min(batch_row) AS start, count(*) AS length FROM ch GROUP BY ALL),
dr AS (SELECT batch_id, chunk, pos, {_DRAW("rows")} AS sampled_row FROM plan JOIN bs USING (batch_id)),
deg AS (SELECT dr.batch_id, dr.chunk, pos, sampled_row, dst AS neg FROM dr JOIN ch ON ch.batch_id = dr.batch_id AND ch.batch_row = dr.sampled_row)"""


@query(f"{KG}, {CHUNKED}, {_UNI} SELECT * FROM uni")
def neg_uniform(spark, d):
    e, n = chunked(spark, d)
    return negatives.uniform(e, NEGATIVES, n)


@query(f"{KG}, {CHUNKED}, {_DEG} SELECT * FROM deg")
def neg_degree_batch(spark, d):
    return negatives.degree_in_batch(chunked(spark, d)[0], NEGATIVES).select("batch_id", "chunk", "pos", "sampled_row", "neg")


@query(f"""{KG}, {CHUNKED}, {_DEG}, ex AS (SELECT batch_id, chunk, pos, {_DRAW("greatest(rows - length, 1)")} AS u, {_DRAW("rows")} AS any_row, rows, start, length FROM plan JOIN bs USING (batch_id) JOIN sp USING (batch_id, chunk)),
exr AS (SELECT batch_id, chunk, pos, CASE WHEN rows > length THEN u + CASE WHEN u >= start THEN length ELSE 0 END ELSE any_row END AS sampled_row FROM ex)
SELECT exr.batch_id, exr.chunk, pos, sampled_row, dst AS neg FROM exr JOIN ch ON ch.batch_id = exr.batch_id AND batch_row = sampled_row""")
def neg_chunk_exclusion(spark, d):
    return negatives.degree_in_batch(chunked(spark, d)[0], NEGATIVES, exclude_chunk=True).select("batch_id", "chunk", "pos", "sampled_row", "neg")


@query(f"""{KG}, {CHUNKED}, dg AS (SELECT node_id, count(*) AS d FROM (SELECT unnest([src, dst]) AS node_id FROM kg) GROUP BY ALL),
cu AS (SELECT node_id, sum(d) OVER (ORDER BY node_id) - d AS low, sum(d) OVER (ORDER BY node_id) AS high FROM dg),
u AS (SELECT batch_id, chunk, pos, {draw_sql(13, KEY, "pos", "SELECT max(high)::BIGINT FROM cu")} AS u FROM plan)
SELECT batch_id, chunk, pos, node_id AS neg FROM u JOIN cu ON u >= low AND u < high""")
def neg_degree_global(spark, d):
    e, _ = chunked(spark, d)
    return negatives.degree_global(e, graph.degrees(e), NEGATIVES)


@query(f"{KG}, {CHUNKED}, {_UNI}, {_DEG} SELECT batch_id, chunk, pos, neg FROM deg WHERE pos < {NEGATIVES // 2} UNION ALL SELECT batch_id, chunk, pos + {NEGATIVES // 2}, neg FROM uni WHERE pos < {NEGATIVES // 2}")
def neg_mixed(spark, d):
    e, n = chunked(spark, d)
    return negatives.mixed(e, NEGATIVES, 0.5, n)


@query(f"{KG}, {CHUNKED}, {_DEG} SELECT ch.edge_id, count(*) AS n FROM ch JOIN deg USING (batch_id, chunk) WHERE sampled_row <> batch_row GROUP BY ALL")
def filter_deg_local(spark, d):
    e, _ = chunked(spark, d)
    pairs = negatives.corrupt(e, negatives.degree_in_batch(e, NEGATIVES))
    return negatives.filter_degree_local(pairs).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{KG}, {CHUNKED}, {_UNI} SELECT ch.edge_id, count(*) AS n FROM ch JOIN uni USING (batch_id, chunk)
WHERE NOT EXISTS (SELECT 1 FROM ch k WHERE k.batch_id = ch.batch_id AND k.src = ch.src AND k.rel = ch.rel AND k.dst = uni.neg) GROUP BY ALL""")
def filter_local_all(spark, d):
    e, n = chunked(spark, d)
    pairs = negatives.corrupt(e, negatives.uniform(e, NEGATIVES, n))
    return negatives.filter_known(pairs, e, same_batch=True).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))


_GLOBAL = """ok AS (SELECT ch.edge_id, ch.src, ch.rel, ch.dst, uni.pos, uni.neg FROM ch JOIN uni USING (batch_id, chunk)
WHERE NOT EXISTS (SELECT 1 FROM kg k WHERE k.src = ch.src AND k.rel = ch.rel AND k.dst = uni.neg))"""


@query(f"{KG}, {CHUNKED}, {_UNI}, {_GLOBAL} SELECT edge_id, count(*) AS n FROM ok GROUP BY ALL")
def filter_global(spark, d):
    e, n = chunked(spark, d)
    pairs = negatives.corrupt(e, negatives.uniform(e, NEGATIVES, n))
    return negatives.filter_known(pairs, e).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{KG} SELECT edge_id, pos.range::INT AS pos, {draw_sql(14, 'edge_id', 'pos.range', '7')} AS neg_rel FROM kg, range(3) pos")
def neg_relations(spark, d):
    return negatives.corrupt_relations(kg(spark, d)[0], 3, 7).select("edge_id", "pos", "neg_rel")


# ---- scores -----------------------------------------------------------------------------------------------------------


def _positive(spark, d, decoder: str) -> DataFrame:
    e, _ = kg(spark, d)
    emb, _ = nodes(spark, d)
    rows = scoring.lookup(scoring.lookup(scoring.lookup(e, emb, "src", "s"), relations(emb), "rel", "r"), emb, "dst", "t")
    return rows.select("edge_id", F.round(scoring.score(decoder, F.col("s"), F.col("r"), F.col("t")), 6).alias("score"))


_SRD = f"{KG}, {EMB}, p AS (SELECT edge_id, a.e AS s, rv AS r, b.e AS t FROM kg JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst JOIN rl ON rl.rel = kg.rel)"
_HAD = "list_transform(range(1, 65), lambda i: s[i] * r[i])"
_CPX = "list_concat(list_transform(range(1, 33), lambda i: s[i] * r[i] - s[i + 32] * r[i + 32]), list_transform(range(1, 33), lambda i: s[i] * r[i + 32] + s[i + 32] * r[i]))"
for _name, _expr in {
    "dot": "list_inner_product(s, t)",
    "l2": "-sqrt(greatest(list_sum(list_transform(range(1, 65), lambda i: (s[i] - t[i]) ** 2)), 1e-8))",
    "cosine": "list_cosine_similarity(s, t)",
    "distmult": f"list_inner_product({_HAD}, t)",
    "transe": "-sqrt(greatest(list_sum(list_transform(range(1, 65), lambda i: (s[i] + r[i] - t[i]) ** 2)), 1e-8))",
    "complex": f"list_inner_product({_CPX}, t)",
}.items():
    QUERIES[f"score_{_name}"] = lambda spark, d, k=_name: _positive(spark, d, k)
    SQL[f"score_{_name}"] = f"WITH {_SRD} SELECT edge_id, round({_expr}, 6) AS score FROM p"


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Uniform negatives of all edges under DistMult, and the edges."""
    e, n = chunked(spark, d)
    emb, _ = nodes(spark, d)
    own = e.select("edge_id", "batch_id", "chunk", "src", "rel", "dst")
    return scoring.score_negatives(own, negatives.uniform(e, NEGATIVES, n), emb, relations(emb)), e


def scored_negatives(spark, d) -> DataFrame:
    """edge_id, pos, neg, pos_score, score: the score of known edges is masked."""
    scored, e = _scored(spark, d)
    return negatives.mask_known(scored, e).select("edge_id", "pos", "neg", "pos_score", "score")


_MASKED = """al AS (SELECT ch.edge_id, uni.pos, uni.neg, EXISTS (SELECT 1 FROM kg k WHERE k.src = ch.src AND k.rel = ch.rel AND k.dst = uni.neg) AS known
FROM ch JOIN uni USING (batch_id, chunk))"""
_SC = f"""{KG}, {EMB}, {CHUNKED}, {_UNI}, {_MASKED},
p AS (SELECT edge_id, a.e AS s, rv AS r, b.e AS t FROM kg JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst JOIN rl ON rl.rel = kg.rel),
q AS (SELECT edge_id, {_HAD} AS q, list_inner_product({_HAD}, t) AS pos_score FROM p),
sc AS (SELECT edge_id, pos, neg, pos_score, CASE WHEN NOT known THEN list_inner_product(q, emb.e) END AS score FROM al JOIN q USING (edge_id) JOIN emb ON vec_id = neg)"""


@query(f"{_SC} SELECT edge_id, count_if(score >= pos_score) + 1 AS rank FROM sc GROUP BY ALL")
def rank_sampled(spark, d):
    return scoring.filtered_rank(*_scored(spark, d))


@query(f"""{_SC}, rk AS (SELECT edge_id, count_if(score >= pos_score) + 1 AS rank FROM sc GROUP BY ALL)
SELECT count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits_{k}" for k in scoring.HITS)} FROM rk""")
def lp_metrics(spark, d):
    return scoring.metrics(scoring.filtered_rank(*_scored(spark, d)))


@query(f"{_SC} SELECT edge_id, pos, neg FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY round(score, 9) DESC, pos) AS k FROM sc WHERE score IS NOT NULL) WHERE k <= 3")
def dns_topk(spark, d):
    return scoring.top_k(scored_negatives(spark, d).withColumn("score", F.round("score", 9)), 3).select("edge_id", "pos", "neg")


@query(f"{_SC} SELECT edge_id, pos // 5 AS grp, arg_max(pos, (round(score, 9), -pos)) AS pos FROM sc WHERE score IS NOT NULL GROUP BY ALL")
def dns_tournament(spark, d):
    return scoring.tournament(scored_negatives(spark, d).withColumn("score", F.round("score", 9)), NEGATIVES, 2).select("edge_id", "grp", F.col("pos").cast("bigint").alias("pos"))


def _loss(name: str):
    def run(spark, d):
        return scoring.losses(scored_negatives(spark, d)).select("edge_id", F.round(name, 5).alias(name))

    return run


_SOFTPLUS = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_LOSS = {
    "softmax_ce": "ln(exp(any_value(pos_score)) + coalesce(sum(exp(score)), 0)) - any_value(pos_score)",
    "ranking": "coalesce(sum(CASE WHEN score IS NOT NULL THEN greatest(0, score - pos_score + 0.1::DOUBLE) END), 0)",
    "bce_logits": f"coalesce(sum({_SOFTPLUS('score')}), 0) + {_SOFTPLUS('-any_value(pos_score)')}",
    "bce_sigmoid": f"coalesce(sum(CASE WHEN score IS NOT NULL THEN least({_SOFTPLUS('score')}, 100) END), 0) + least({_SOFTPLUS('-any_value(pos_score)')}, 100)",
    "softplus": f"coalesce(sum({_SOFTPLUS('score')}), 0) + {_SOFTPLUS('-any_value(pos_score)')}",
    "mse": "coalesce(sum(score * score), 0) + (any_value(pos_score) - 1) ** 2",
}
for _name, _expr in _LOSS.items():
    QUERIES[f"loss_{_name}"] = _loss(_name)
    SQL[f"loss_{_name}"] = f"WITH {_SC} SELECT edge_id, round({_expr}, 5) AS {_name} FROM sc GROUP BY edge_id"


@query(f"{KG}, {EMB}, c AS (SELECT emb.vec_id, label, list(list_inner_product(emb.e, rv) ORDER BY rl.rel) AS l FROM emb, rl GROUP BY ALL) SELECT round(100 * avg((list_position(l, list_max(l)) - 1 = label)::INT), 6) AS accuracy, count(*) AS n FROM c")
def node_accuracy(spark, d):
    emb, _ = nodes(spark, d)
    rel = relations(emb).orderBy("vec_id").select(F.col("embedding").cast("array<double>")).collect()  # seven rows
    logits = F.array(*[V.dot(F.col("e"), F.array(*[F.lit(x) for x in r[0]])) for r in rel])
    return scoring.accuracy(emb.select("label", V.doubles("embedding").alias("e")).select("label", logits.alias("logits")))


_TEST = f"{KG}, {_PLACE}, {EMB}, te AS (SELECT edge_id, src, rel, dst FROM pl WHERE place >= floor(total * 0.95))"


@query(f"""{_TEST}, q AS (SELECT edge_id, te.src, te.rel, te.dst, list_transform(range(1, 65), lambda i: a.e[i] * rv[i]) AS q FROM te JOIN emb a ON a.vec_id = src JOIN rl ON rl.rel = te.rel),
ps AS (SELECT q.*, list_inner_product(q, e) AS s FROM q JOIN emb ON vec_id = dst),
al AS (SELECT edge_id, src, rel, dst, vec_id, list_inner_product(q, e) >= s - 1e-9 * greatest(1, abs(s)) AS hit FROM ps, emb)
SELECT edge_id, count_if(hit AND vec_id <> dst) + 1 AS rank_raw, count_if(hit AND NOT EXISTS (SELECT 1 FROM kg k WHERE k.src = al.src AND k.rel = al.rel AND k.dst = al.vec_id)) + 1 AS rank FROM al GROUP BY edge_id""")
def rank_filtered_all_nodes(spark, d):
    """The last 5 % in shuffled order are the test set; every node but the edge's own dst is a candidate."""
    e = materialise(kg(spark, d)[0])
    emb, _ = nodes(spark, d)
    total = e.count()
    test = partition.shuffled_rank(e, 1).filter(F.col("place") >= int(total * 0.95)).select("edge_id", "src", "rel", "dst")
    raw = scoring.all_node_ranks(test, emb, relations(emb))
    # known candidates are few: they are scored one by one and taken off the count
    facts = e.select("src", "rel", F.col("dst").alias("neg")).distinct()
    rows = scoring.lookup(scoring.lookup(test, emb, "src", "s"), relations(emb), "rel", "r")
    rows = scoring.lookup(rows, emb, "dst", "t").withColumn("q", V.hadamard(F.col("s"), F.col("r")))
    rows = rows.select("edge_id", "src", "rel", "dst", "q", V.dot(F.col("q"), F.col("t")).alias("p"))
    rows = scoring.lookup(rows.join(facts, ["src", "rel"]).filter("neg <> dst"), emb, "neg", "v")
    hit = V.dot(F.col("q"), F.col("v")) >= F.col("p") - 1e-9 * F.greatest(F.lit(1.0), F.abs("p"))
    known = rows.groupBy("edge_id").agg(F.count_if(hit).alias("k"))
    return raw.join(known, "edge_id", "left").select("edge_id", "rank_raw", (F.col("rank_raw") - F.coalesce("k", F.lit(0))).alias("rank"))


# ---- neighbours and layers --------------------------------------------------------------------------------------------

_BOTH = "nb AS (SELECT src AS node_id, dst AS nbr, edge_id FROM kg UNION ALL SELECT dst, src, edge_id FROM kg)"
#: All nodes are seeds, in so many batches of neighbouring ids; a batch has its own hops.
SEED_BATCHES = 8


def _khop_sql(drawn: Callable[[int], str]) -> str:
    """Two hops; ``drawn`` gives the sampled neighbours for the seed of a hop."""
    step = lambda k, f: f"s{k} AS ({drawn(k + 1)}), r{k} AS (SELECT DISTINCT batch_id, nbr AS node_id FROM {f} JOIN s{k} USING (node_id))"
    return (f"{KG}, {_BOTH}, h0 AS (SELECT vec_id // ((n + {SEED_BATCHES - 1}) // {SEED_BATCHES}) AS batch_id, vec_id AS node_id FROM embeddings, n), "
            f"{step(1, 'h0')}, h1 AS (SELECT * FROM r1 EXCEPT SELECT * FROM h0), {step(2, 'h1')}, h2 AS (SELECT * FROM r2 EXCEPT SELECT * FROM h1 EXCEPT SELECT * FROM h0) "
            "SELECT batch_id, node_id, 0 AS hop FROM h0 UNION ALL SELECT batch_id, node_id, 1 FROM h1 UNION ALL SELECT batch_id, node_id, 2 FROM h2")


def _seeds(spark, d):
    emb = table(spark, d, "embeddings")
    size = partition.partition_size(emb.count(), SEED_BATCHES)
    return emb.select(F.floor(F.col("vec_id") / size).alias("batch_id"), F.col("vec_id").alias("node_id"))


@query(_khop_sql(lambda seed: "SELECT node_id, nbr FROM nb"))
def khop_all(spark, d):
    return graph.khop(_seeds(spark, d), materialise(kg(spark, d)[0]), 2, by=("batch_id",))


@query(_khop_sql(lambda seed: f"SELECT node_id, nbr FROM nb QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY {h_sql(seed, 'edge_id', 'node_id')}, edge_id, nbr) <= 5"))
def khop_uniform(spark, d):
    return graph.khop(_seeds(spark, d), materialise(kg(spark, d)[0]), 2, "uniform", limit=5, by=("batch_id",))


@query(_khop_sql(lambda seed: f"SELECT node_id, nbr FROM nb WHERE {h_sql(seed, 'edge_id', 'node_id')} >= {int(0.9 * M)}"))
def khop_dropout(spark, d):
    return graph.khop(_seeds(spark, d), materialise(kg(spark, d)[0]), 2, "dropout", rate=0.9, by=("batch_id",))


def _x(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), V.doubles("embedding").alias("x"))


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v: F.round(v, digits) + 0.0))


@query(f"""{KG}, {EMB}, m AS (SELECT dst AS node_id, unnest(e) AS v, unnest(range(64)) AS i FROM kg JOIN emb ON vec_id = src),
s AS (SELECT node_id, i, avg(v) AS a, count(*) AS n FROM m GROUP BY ALL) SELECT node_id, any_value(n) AS n, list(round(a, 5) + 0.0 ORDER BY i) AS x FROM s GROUP BY ALL""")
def seg_sum_mean(spark, d):
    rows = gnn.messages(kg(spark, d, False)[0], _x(spark, d))
    mean = gnn.vector_sum(rows, ["node_id"], "x", DIM, mean=True)
    return _rounded(mean.join(rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")), "node_id"))


@query(f"""{KG}, g AS (SELECT dst AS node_id, count(*) AS d FROM kg GROUP BY ALL)
SELECT src, kg.dst, count(*) AS n, round(1 / sqrt((coalesce(any_value(a.d), 0) + 1.0::DOUBLE) * (any_value(b.d) + 1.0::DOUBLE)), 6) AS weight FROM kg LEFT JOIN g a ON a.node_id = src JOIN g b ON b.node_id = dst GROUP BY src, kg.dst""")
def gcn_norm(spark, d):
    return gnn.gcn_norm(kg(spark, d, False)[0]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query(f"""{KG}, {EMB}, s AS (SELECT edge_id, dst AS node_id, list_inner_product(a.e, b.e) AS logit FROM kg JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst
UNION ALL SELECT -1, vec_id, list_inner_product(e, e) FROM emb), m AS (SELECT node_id, max(logit) AS m FROM s GROUP BY ALL), z AS (SELECT node_id, m, sum(exp(logit - m)) AS z FROM s JOIN m USING (node_id) GROUP BY ALL)
SELECT edge_id, node_id, round(exp(logit - m) / z, 6) AS alpha FROM s JOIN z USING (node_id)""")
def attention_softmax(spark, d):
    e, emb = kg(spark, d)[0], nodes(spark, d)[0]
    rows = scoring.lookup(scoring.lookup(e, emb, "src", "s"), emb, "dst", "t").select("edge_id", F.col("dst").alias("node_id"), V.dot(F.col("s"), F.col("t")).alias("logit"))
    own = emb.select(F.lit(-1).cast("bigint").alias("edge_id"), F.col("vec_id").alias("node_id"), V.doubles("embedding").alias("e")).withColumn("logit", V.dot(F.col("e"), F.col("e"))).drop("e")
    return gnn.attention(rows.unionByName(own)).select("edge_id", "node_id", F.round("alpha", 6).alias("alpha"))


def _weights(out: int, seed: int, dim: int = DIM) -> np.ndarray:
    """Small numbers from the hash of their place, so that SQL can make them too."""
    return ((h_numpy(seed, np.arange(out * dim)) + 0.5) / M * 2 - 1).reshape(out, dim) * 0.1


def _weights_sql(out: int, seed: int, dim: int = DIM) -> str:
    one = f"(({h_sql(seed, f'k * {dim} + j')} + 0.5::DOUBLE) / {M} * 2 - 1) * 0.1"
    return f"list_transform(range({out}), lambda k: list_transform(range({dim}), lambda j: {one}))"


def _times(w: str, x: str) -> str:
    return f"list_transform({w}, lambda r: list_inner_product({x}, r))"


def _zeros(n: int) -> str:
    return f"list_transform(range({n}), lambda i: 0.0::DOUBLE)"


def _means(name: str, pairs: str, source: str, value: str = "v", f: str = "avg", dim: int = DIM) -> str:
    """``name`` (node_id, a): the element-wise mean or sum of the neighbours' vectors (node_id, x) over ``pairs`` (node_id, nbr)."""
    return f"""{name}_u AS (SELECT p.node_id, unnest(s.x) AS v, unnest(range({dim})) AS i FROM {pairs} p JOIN {source} s ON s.node_id = p.nbr),
{name} AS (SELECT node_id, list(a ORDER BY i) AS a FROM (SELECT node_id, i, {f}({value}) AS a FROM {name}_u GROUP BY ALL) GROUP BY node_id)"""


_ROUND = lambda x: f"list_transform({x}, lambda v: round(v, 5) + 0.0)"
_PLUS = lambda a, b, n: f"list_transform(range(1, {n + 1}), lambda i: {a}[i] + {b}[i])"
_X0 = "x0 AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS x FROM embeddings)"
_INTO = "inc AS (SELECT dst AS node_id, src AS nbr FROM kg)"
_TWO = "two AS (SELECT dst AS node_id, src AS nbr FROM kg UNION ALL SELECT src, dst FROM kg)"
_HEADS = [(_weights(8, 1), _weights(1, 41, 8)[0], _weights(1, 42, 8)[0]), (_weights(8, 3), _weights(1, 43, 8)[0], _weights(1, 44, 8)[0])]


def _layer(f, sql: str):
    def run(spark, d):
        return _rounded(f(kg(spark, d, False)[0], _x(spark, d)))

    return run, "WITH " + sql


_SAGE = lambda out, source, dim, w1, w2, name: f"""{_means(name + '_n', 'two', source, dim=dim)}, {name}_w AS (SELECT {_weights_sql(out, w1, dim)} AS w1, {_weights_sql(out, w2, dim)} AS w2),
{name}_p AS (SELECT s.node_id, {_times('w1', 's.x')} AS p, {_times('w2', f'coalesce(a, {_zeros(dim)})')} AS q FROM {source} s LEFT JOIN {name}_n USING (node_id), {name}_w),
{name} AS (SELECT node_id, {_PLUS('p', 'q', out)} AS x FROM {name}_p)"""  # noqa: E731


def _gat_sql() -> str:
    parts = [f"{KG}, {_X0}, nb0 AS (SELECT dst AS node_id, src AS nbr FROM kg UNION ALL SELECT node_id, node_id FROM x0)"]
    for k, (w, c, b) in enumerate(((1, 41, 42), (3, 43, 44))):
        parts.append(f"""w{k} AS (SELECT {_weights_sql(8, w)} AS w, {_weights_sql(1, c, 8)}[1] AS c, {_weights_sql(1, b, 8)}[1] AS b), z{k} AS (SELECT node_id, {_times('w', 'x')} AS z FROM x0, w{k}),
r{k} AS (SELECT nb0.node_id, n.z, list_inner_product(o.z, c) + list_inner_product(n.z, b) AS raw FROM nb0 JOIN z{k} o ON o.node_id = nb0.node_id JOIN z{k} n ON n.node_id = nbr, w{k}),
l{k} AS (SELECT node_id, z, CASE WHEN raw > 0 THEN raw ELSE raw * 0.2::DOUBLE END AS l FROM r{k}), m{k} AS (SELECT node_id, max(l) AS m FROM l{k} GROUP BY ALL),
u{k} AS (SELECT node_id, unnest(z) AS v, unnest(range(8)) AS i, exp(l - m) AS e FROM l{k} JOIN m{k} USING (node_id)),
h{k} AS (SELECT node_id, list(s ORDER BY i) AS x FROM (SELECT node_id, i, sum(v * e) / sum(e) AS s FROM u{k} GROUP BY ALL) GROUP BY node_id)""")
    return ", ".join(parts)


_LAYERS = {
    "layer_sage_mean": (lambda e, x: gnn.sage(e, x, DIM, _weights(8, 1), _weights(8, 2)), f"{KG}, {_X0}, {_TWO}, {_SAGE(8, 'x0', DIM, 1, 2, 'o')} SELECT node_id, {_ROUND('x')} AS x FROM o"),
    "layer_sage_gcn": (lambda e, x: gnn.sage(e, x, DIM, _weights(8, 1), kind="gcn"), f"""{KG}, {_X0}, {_TWO}, {_means('s', 'two', 'x0', f='sum')}, d AS (SELECT node_id, count(*) AS d FROM two GROUP BY ALL),
y AS (SELECT node_id, list_transform(range(1, {DIM + 1}), lambda i: (coalesce(a[i], 0) + x[i]) / (coalesce(d, 0) + 1)) AS y FROM x0 LEFT JOIN s USING (node_id) LEFT JOIN d USING (node_id)), w AS (SELECT {_weights_sql(8, 1)} AS w)
SELECT node_id, {_ROUND(_times('w', 'y'))} AS x FROM y, w"""),
    "layer_gcn": (lambda e, x: gnn.gcn(e, x, DIM, _weights(8, 1)), f"""{KG}, {_X0}, {_INTO}, d AS (SELECT node_id, count(*) AS d FROM inc GROUP BY ALL),
x1 AS (SELECT node_id, list_transform(x, lambda v: v / sqrt(coalesce(d, 0) + 1.0::DOUBLE)) AS x, sqrt(coalesce(d, 0) + 1.0::DOUBLE) AS r FROM x0 LEFT JOIN d USING (node_id)), {_means('s', 'inc', 'x1', f='sum')},
y AS (SELECT node_id, list_transform(range(1, {DIM + 1}), lambda i: (coalesce(a[i], 0) + x[i]) / r) AS y FROM x1 LEFT JOIN s USING (node_id)), w AS (SELECT {_weights_sql(8, 1)} AS w) SELECT node_id, {_ROUND(_times('w', 'y'))} AS x FROM y, w"""),
    "layer_gat": (lambda e, x: gnn.gat(e, x, DIM, _HEADS), f"{_gat_sql()} SELECT h0.node_id, {_ROUND('list_concat(h0.x, h1.x)')} AS x FROM h0 JOIN h1 USING (node_id)"),
    "layer_gat_average": (lambda e, x: gnn.gat(e, x, DIM, _HEADS, average=True), f"{_gat_sql()} SELECT h0.node_id, {_ROUND('list_transform(range(1, 9), lambda i: (h0.x[i] + h1.x[i]) / 2)')} AS x FROM h0 JOIN h1 USING (node_id)"),
    "layer_rgcn": (lambda e, x: gnn.rgcn(e, x, DIM, {r: _weights(8, 50 + r) for r in range(7)}, _weights(8, 9)), f"""{KG}, {_X0}, w AS (SELECT [{', '.join(_weights_sql(8, 50 + r) for r in range(7))}] AS w, {_weights_sql(8, 9)} AS own),
y AS (SELECT src AS node_id, {_times('w[rel + 1]', 'x')} AS y FROM kg JOIN x0 ON x0.node_id = dst, w), u AS (SELECT node_id, unnest(y) AS v, unnest(range(8)) AS i FROM y),
s AS (SELECT node_id, list(a ORDER BY i) AS a FROM (SELECT node_id, i, avg(v) AS a FROM u GROUP BY ALL) GROUP BY node_id), p AS (SELECT node_id, {_times('own', 'x')} AS p, coalesce(a, {_zeros(8)}) AS a FROM x0 LEFT JOIN s USING (node_id), w)
SELECT node_id, {_ROUND(_PLUS('p', 'a', 8))} AS x FROM p"""),
}
for _name, _pair in _LAYERS.items():
    QUERIES[_name], SQL[_name] = _layer(*_pair)

_CORE_OF = {4: 6, 5: 4}  # modes of a core -> its size
_CORE_AT = lambda n: f"list_transform(range({n}), lambda i: (({h_sql(61, 'i')} + 0.5::DOUBLE) / {M} * 2 - 1) * 0.1)"


def _core(modes: int) -> np.ndarray:
    return _weights(1, 61, _CORE_OF[modes] ** modes).reshape((_CORE_OF[modes],) * modes)


def _tucker_sql(four: bool) -> str:
    """Whole vectors are projected into the core, the core is summed over its closed modes, its open mode is projected back."""
    given = ["a", "b", "c", "f"][: 3 + four]
    modes, size = 4 + four, _CORE_OF[4 + four]
    names = {"a": ("src", "me", 0), "b": ("rel", "mr", 1), "c": ("qrel" if four else "qval", "mr" if four else "me", 3), "f": ("qval", "me", 4)}
    proj = ", ".join(f"list_transform(range(1, {size + 1}), lambda k: list_inner_product({n}.e, list_transform({names[n][1]}, lambda row: row[k]))) AS p{n}" for n in given)
    digit = lambda m: f"(i // {size ** (len(given) - 1 - m)}) % {size} + 1"
    product = " * ".join(f"p{n}[{digit(m)}]" for m, n in enumerate(given))
    # place of (open mode r, closed modes i) in the flat core p q r s [t]
    place = " + ".join([*[f"({digit(m)} - 1) * {size ** (modes - 1 - names[n][2])}" for m, n in enumerate(given)], f"r * {size ** (modes - 3)}"])
    return f"""{KG}, {EMB}, core AS (SELECT {_CORE_AT(size**modes)} AS w, {_weights_sql(DIM, 62, size)} AS me, {_weights_sql(DIM, 63, size)} AS mr),
flat AS (SELECT me, mr, list_transform(range({size}), lambda r: list_transform(range({size ** len(given)}), lambda i: w[({place} + 1)::BIGINT])) AS w FROM core),
pr AS (SELECT edge_id, {proj}, t.e AS t, w, me FROM kg JOIN emb a ON a.vec_id = src JOIN (SELECT rel AS vec_id, rv AS e FROM rl) b ON b.vec_id = kg.rel {'JOIN (SELECT rel AS vec_id, rv AS e FROM rl) c ON c.vec_id = qval % 7 JOIN emb f ON f.vec_id = qval' if four else 'JOIN emb c ON c.vec_id = qval'} JOIN emb t ON t.vec_id = dst, flat),
sm AS (SELECT edge_id, t, me, w, list_transform(range({size ** len(given)}), lambda i: {product}) AS o FROM pr),
op AS (SELECT edge_id, t, me, list_transform(w, lambda v: list_inner_product(v, o)) AS y FROM sm)
SELECT edge_id, round(list_inner_product(list_transform(me, lambda row: list_inner_product(row, y)), t), 6) + 0.0 AS score FROM op"""


def _tucker(spark, d, four: bool) -> DataFrame:
    e, emb = kg(spark, d)[0], nodes(spark, d)[0]
    e = e.select("edge_id", "src", "rel", (F.col("qval") % 7).alias("qrel"), "qval", "dst")
    size = _CORE_OF[4 + four]
    rows = scoring.tucker_edges(e, emb, relations(emb), _core(4 + four), _weights(DIM, 62, size), _weights(DIM, 63, size))
    return rows.select("edge_id", (F.round("score", 6) + 0.0).alias("score"))


@query(_tucker_sql(False))
def score_tucker3(spark, d):
    return _tucker(spark, d, False)


@query(_tucker_sql(True))
def score_tucker4(spark, d):
    return _tucker(spark, d, True)


@query(f"""{_SC}, m AS (SELECT edge_id, max(score) AS m FROM sc WHERE score IS NOT NULL GROUP BY ALL), z AS (SELECT edge_id, m, sum(exp(score - m)) AS z FROM sc JOIN m USING (edge_id) WHERE score IS NOT NULL GROUP BY ALL),
l AS (SELECT edge_id, score - m - ln(z) AS lp, 2 * (1 / (1 + exp(-score)) - 0.5::DOUBLE) AS reward FROM sc JOIN z USING (edge_id) WHERE score IS NOT NULL)
SELECT edge_id, round(-avg(lp * reward * exp(lp)), 6) + 0.0 AS loss, round(avg(reward), 6) + 0.0 AS reward FROM l GROUP BY ALL""")
def gan_reward(spark, d):
    return scoring.gan_rewards(scored_negatives(spark, d)).select("edge_id", (F.round("loss", 6) + 0.0).alias("loss"), (F.round("reward", 6) + 0.0).alias("reward"))


# ---- updates ----------------------------------------------------------------------------------------------------------

_GRAD = f"{KG}, {EMB}, g AS (SELECT dst AS node_id, unnest(e) AS v, unnest(range(64)) AS i FROM kg JOIN emb ON vec_id = src), s AS (SELECT node_id, i, sum(v) AS g FROM g GROUP BY ALL), w AS (SELECT vec_id AS node_id, unnest(e) AS x, unnest(range(64)) AS i FROM emb)"


def _gradients(spark, d):
    return gnn.messages(kg(spark, d, False)[0], _x(spark, d)).select("node_id", F.col("x").alias("g"))


@query(f"{_GRAD} SELECT node_id, list(round(CASE WHEN g IS NULL THEN x ELSE x - 0.1::DOUBLE * g / (sqrt(1 + g * g) + 1e-10) END, 5) + 0.0 ORDER BY i) AS x FROM w LEFT JOIN s USING (node_id, i) GROUP BY ALL")
def adagrad_step(spark, d):
    t = _x(spark, d).withColumn("state", F.array_repeat(F.lit(1.0), DIM))
    return _rounded(optim.adagrad(t, _gradients(spark, d), DIM, 0.1).select("node_id", "x"))


@query(f"{_GRAD} SELECT node_id, list(round(x + coalesce(g, 0), 5) + 0.0 ORDER BY i) AS x FROM w LEFT JOIN s USING (node_id, i) GROUP BY ALL")
def scatter_add(spark, d):
    return _rounded(optim.scatter_add(_x(spark, d), _gradients(spark, d), DIM))


@query("SELECT vec_id AS node_id, round(CASE WHEN vec_id % 3 = 0 THEN 2 * embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS x0 FROM embeddings")
def scatter_put(spark, d):
    x = _x(spark, d)
    new = x.filter("node_id % 3 = 0").withColumn("x", V.scale(F.col("x"), F.lit(2.0)))
    return optim.scatter_put(x, new).select("node_id", F.round(F.col("x")[0], 6).alias("x0"))


@query(f"n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS node_id, round(list_sum(list_transform(range(8), lambda k: abs((({h_sql(3, 'vec_id', 'k')}) + 0.5::DOUBLE) / {M} * 2 - 1) * sqrt(6 / (n + 8.0::DOUBLE)))), 6) AS x FROM embeddings, n")
def init_glorot(spark, d):
    emb, n = nodes(spark, d)
    v = optim.initialise("glorot_uniform", 8, "vec_id", rows=n)
    return emb.select(F.col("vec_id").alias("node_id"), F.round(V.total(F.transform(v, F.abs)), 6).alias("x"))


def _trained(spark, d, decoder: str, loss: str) -> tuple[DataFrame, DataFrame]:
    e, n = chunked(spark, d)
    emb, _ = nodes(spark, d)
    e = negatives.gathered(e, negatives.uniform(e, 2, n))
    t = _x(spark, d).withColumn("state", F.array_repeat(F.lit(0.1), DIM))
    rule = optim.DenseRule("adagrad", 0.1)
    rel = rule.start(relations(emb).select(F.col("vec_id").cast("bigint").alias("rel"), V.doubles("embedding").alias("x")))
    new, new_rel, _ = training.step(e.select("edge_id", "src", "rel", "dst", "neg"), None, t, rel, decoder, loss, rate=0.1, dense=rule)
    return new, new_rel


@query(f"""{KG}, {EMB}, {CHUNKED}, {_UNI}, q AS (SELECT edge_id, src, kg.rel, dst, a.e AS s, rv AS r, {_HAD.replace('s[i]', 'a.e[i]').replace('r[i]', 'rv[i]')} AS q FROM kg JOIN emb a ON a.vec_id = src JOIN rl ON rl.rel = kg.rel),
c AS (SELECT edge_id, dst AS cand, 1.0::DOUBLE AS y FROM kg UNION ALL SELECT edge_id, neg, 0.0 FROM ch JOIN uni USING (batch_id, chunk) WHERE pos < 2),
sc AS (SELECT c.edge_id, cand, y, e AS t, q.src, q.rel, s, r, q, list_inner_product(q, e) AS score FROM c JOIN q USING (edge_id) JOIN emb ON vec_id = cand),
m AS (SELECT edge_id, max(score) AS m FROM sc GROUP BY ALL), z AS (SELECT edge_id, m, sum(exp(score - m)) AS z FROM sc JOIN m USING (edge_id) GROUP BY ALL),
d AS (SELECT sc.*, exp(score - m) / z - y AS d FROM sc JOIN z USING (edge_id)),
g AS (SELECT 0 AS kind, cand AS id, unnest(list_transform(q, lambda v: v * d)) AS g, unnest(range({DIM})) AS i FROM d
      UNION ALL SELECT 0, src, unnest(list_transform(range(1, {DIM + 1}), lambda i: t[i] * r[i] * d)), unnest(range({DIM})) FROM d
      UNION ALL SELECT 1, rel, unnest(list_transform(range(1, {DIM + 1}), lambda i: t[i] * s[i] * d)), unnest(range({DIM})) FROM d),
sm AS (SELECT kind, id, i, sum(g) AS g FROM g GROUP BY ALL),
w AS (SELECT 0 AS kind, vec_id AS id, unnest(e) AS x, unnest(range({DIM})) AS i FROM emb UNION ALL SELECT 1, rel, unnest(rv), unnest(range({DIM})) FROM rl)
SELECT kind, id, list(round(CASE WHEN g IS NULL THEN x WHEN kind = 0 THEN x - 0.1::DOUBLE * g / (sqrt(0.1::DOUBLE + g * g) + 1e-10) ELSE x - 0.1::DOUBLE * g / (sqrt(g * g) + 1e-8) END, 4) + 0.0 ORDER BY i) AS x
FROM w LEFT JOIN sm USING (kind, id, i) GROUP BY ALL""")
def train_epoch_distmult(spark, d):
    """Nodes (kind 0) and relations (1) after one step of softmax cross-entropy."""
    new, rel = _trained(spark, d, "distmult", "softmax_ce")
    one = lambda t, kind, key: t.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "x")
    return _rounded(one(new, 0, "node_id").unionByName(one(rel, 1, "rel")), 4)


# ---- schedules and analyzers ------------------------------------------------------------------------------------------

DEVICES = 4
STATES = [s for r in schedule.disjoint_rounds(PARTS) for s in r]
SWAPS = schedule.swap_ordering(PARTS, 4)
SCHED = f"sch AS (SELECT state, part, (state % {DEVICES})::INT AS lane, state // {DEVICES} AS superstep FROM {schedule.as_values(STATES)})"
SWAP = f"sch AS (SELECT state, part, (state % {DEVICES})::INT AS lane, state // {DEVICES} AS superstep FROM {schedule.as_values(SWAPS)})"
OWNER = "ow AS (SELECT a.part AS src_part, b.part AS dst_part, min(a.state) AS state FROM sch a JOIN sch b ON a.state = b.state GROUP BY ALL)"
STATED = f"{KG}, {BUCKETS}, {SCHED}, {OWNER}, se AS (SELECT edge_id, src, dst, state FROM bk JOIN ow USING (src_part, dst_part))"


def _sched(spark, states=None):
    return analyze.lanes(schedule.as_table(spark, states or STATES), DEVICES)


def _state_edges(spark, d):
    e, n = kg(spark, d)
    return partition.with_buckets(e, n, PARTS).join(F.broadcast(analyze.first_owner(_sched(spark))), ["src_part", "dst_part"])


@query(f"{SCHED}, {OWNER} SELECT * FROM ow")
def bucket_owner_greedy(spark, d):
    return analyze.first_owner(_sched(spark))


@query(f"""{SCHED}, b AS (SELECT DISTINCT a.part AS src_part, b.part AS dst_part, a.state FROM sch a JOIN sch b ON a.state = b.state)
SELECT src_part, dst_part, arg_min(state, ({h_sql(5, "src_part * 65536 + dst_part", "state")}, state)) AS state FROM b GROUP BY ALL""")
def bucket_owner_random(spark, d):
    return analyze.random_owner(_sched(spark))


@query(f"{KG}, {BUCKETS}, {SCHED} SELECT a.state, sum(edges)::BIGINT AS weight FROM sch a JOIN sch b ON a.state = b.state JOIN sizes ON src_part = a.part AND dst_part = b.part GROUP BY ALL")
def state_weight(spark, d):
    e, n = kg(spark, d, False)
    return analyze.state_weight(_sched(spark), partition.bucket_sizes(e, n, PARTS))


@query(f"{KG}, {BUCKETS}, {SCHED} SELECT edge_id FROM bk WHERE src_part IN (SELECT part FROM sch WHERE state = 3) AND dst_part IN (SELECT part FROM sch WHERE state = 3)")
def active_edges_of_state(spark, d):
    e, n = kg(spark, d)
    s = _sched(spark).filter("state = 3").select("part")
    pairs = s.select(F.col("part").alias("src_part"), F.lit(1).alias("k")).join(s.select(F.col("part").alias("dst_part"), F.lit(1).alias("k")), "k")
    return partition.active_edges(partition.with_buckets(e, n, PARTS), pairs).select("edge_id")


@query(f"""{SWAP}, st AS (SELECT DISTINCT superstep, state FROM sch), pr AS (SELECT a.superstep, a.state AS a, b.state AS b FROM st a JOIN st b ON a.superstep = b.superstep AND a.state < b.state)
SELECT pr.superstep, a, b, (SELECT count(*) FROM sch x JOIN sch y ON x.part = y.part WHERE x.state = pr.a AND y.state = pr.b) AS overlap FROM pr""")
def state_overlap(spark, d):
    return analyze.pair_overlap(_sched(spark, SWAPS))


@query(f"""{SCHED} SELECT lane, state, part, EXISTS (SELECT 1 FROM sch n WHERE n.lane = s.lane AND n.superstep = s.superstep + 1 AND n.part = s.part) AS retained,
EXISTS (SELECT 1 FROM sch n WHERE n.part = s.part AND n.superstep BETWEEN s.superstep + 1 AND s.superstep + 2) AS used_later FROM sch s""")
def handoff_horizon(spark, d):
    return analyze.handoff(_sched(spark), 2)


@query(f"""{STATED}, ac AS (SELECT state, entity, count(*) AS n FROM (SELECT state, unnest([src, dst]) AS entity FROM se) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, entity) AS r FROM ac) SELECT state, sum(n)::BIGINT AS accesses, round(sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM rk GROUP BY ALL""")
def hot_entity_coverage(spark, d):
    return analyze.top_k_coverage(analyze.access_counts(_state_edges(spark, d)), 10)


@query(f"""{STATED}, ac AS (SELECT state, (state % {DEVICES}) AS lane, state // {DEVICES} AS at, entity, count(*) AS n FROM (SELECT state, unnest([src, dst]) AS entity FROM se) GROUP BY ALL)
SELECT state, sum(n)::BIGINT AS accesses, round(sum(CASE WHEN EXISTS (SELECT 1 FROM ac p WHERE p.lane = a.lane AND p.entity = a.entity AND p.at BETWEEN a.at - 2 AND a.at - 1) THEN n ELSE 0 END) / sum(n), 6) AS seen_coverage FROM ac a GROUP BY ALL""")
def history_coverage(spark, d):
    return analyze.history_coverage(analyze.access_counts(_state_edges(spark, d)), 2, DEVICES)


@query(f"{SWAP}, i AS (SELECT *, superstep - row_number() OVER (PARTITION BY lane, part ORDER BY superstep) AS island FROM sch) SELECT lane, part, min(superstep) AS first_step, max(superstep) AS last_step, count(*) AS steps FROM i GROUP BY lane, part, island")
def residency_segments(spark, d):
    return analyze.residency_segments(_sched(spark, SWAPS))


@query(f"{SCHED}, u AS (SELECT DISTINCT part, superstep FROM sch), g AS (SELECT part, lead(superstep) OVER (PARTITION BY part ORDER BY superstep) - superstep AS gap FROM u), l AS (SELECT part, count(*) AS visits, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS gs, max(gap) AS max_gap FROM g GROUP BY ALL) SELECT part, visits, gs[len(gs) // 2 + 1] AS median_gap, max_gap FROM l")
def revisit_gap(spark, d):
    return analyze.revisit_gaps(_sched(spark))


@query(f"{KG}, t AS (SELECT edge_id // {BATCH} AS batch_id, unnest([src, dst]) AS e FROM kg) SELECT batch_id, count(*) AS touches, count(DISTINCT e) AS uniq, round(1 - count(DISTINCT e) / count(*), 6) AS duplicate_ratio FROM t GROUP BY ALL")
def batch_touches(spark, d):
    return analyze.batch_touches(partition.batches(kg(spark, d)[0], BATCH))


@query(f"{KG}, t AS (SELECT DISTINCT edge_id // {BATCH} AS batch_id, unnest([src, dst]) AS r FROM kg) SELECT batch_id, count(*) AS rows, count(DISTINCT r // 16) AS chunks, round(count(*) / (count(DISTINCT r // 16) * 16), 6) AS fill, round(count(DISTINCT r // 16) / ((SELECT n + 15 FROM n) // 16), 6) AS chunk_fraction FROM t GROUP BY ALL")
def chunk_fill(spark, d):
    e, n = kg(spark, d)
    return analyze.chunk_fill(partition.batches(e, BATCH), 16, n)


@query(f"""{KG}, t AS (SELECT DISTINCT edge_id // {BATCH} AS batch_id, unnest([src, dst]) AS r FROM kg), u AS (SELECT batch_id, count(*) AS uniq FROM t GROUP BY ALL),
s AS (SELECT a.batch_id, count(*) AS shared FROM t a JOIN t b ON b.batch_id = a.batch_id + 1 AND a.r = b.r GROUP BY ALL)
SELECT u.batch_id, u.uniq, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (u.uniq + v.uniq - coalesce(shared, 0)), 6) AS jaccard FROM u JOIN u v ON v.batch_id = u.batch_id + 1 LEFT JOIN s ON s.batch_id = u.batch_id""")
def distinct_sketch_jaccard(spark, d):
    return analyze.distinct_jaccard(partition.batches(kg(spark, d)[0], BATCH), "batch_id")


@query()
def distinct_theta_sketch(spark, d):
    return analyze.sketch_distinct(partition.batches(kg(spark, d)[0], BATCH), "batch_id")


@query("SELECT event_type, count(*) AS n, min(value) AS min, round(median(value), 6) AS median, round(avg(value), 6) AS avg, max(value) AS max, round(stddev(value), 6) AS std, max(value) - min(value) AS spread FROM events GROUP BY ALL")
def sample_summary(spark, d):
    return analyze.summary(table(spark, d, "events"), "value", ("event_type",))


@query("r AS (SELECT user_id % 50 AS round, user_id % 4 AS lane, count(*) AS ms FROM events GROUP BY ALL) SELECT round, lane, ms, max(ms) OVER (PARTITION BY round) - ms AS wait FROM r")
def lane_barrier(spark, d):
    rounds = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("round"), (F.col("user_id") % 4).alias("lane")).agg(F.count(F.lit(1)).alias("ms"))
    return analyze.lane_barrier(rounds)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windowed(spark, d):
    return windowed_counts(table(spark, d, "events"))


# ---- more of ids and partitions ------------------------------------------------------------------------------------------


@query(f"{KG} SELECT edge_id, src, dst FROM kg WHERE edge_id BETWEEN 500 AND 1499")
def edge_slice(spark, d):
    return partition.row_range(kg(spark, d)[0], 500, 1000).select("edge_id", "src", "dst")


@query(f"""{HETERO}, raw AS (SELECT unnest([src, dst]) AS raw_id FROM het), hub AS (SELECT raw_id FROM raw GROUP BY raw_id ORDER BY count(*) DESC, raw_id LIMIT 50)
SELECT raw_id, row_number() OVER (ORDER BY raw_id NOT IN (SELECT raw_id FROM hub), md5(raw_id), raw_id) - 1 AS mapped_id FROM (SELECT DISTINCT raw_id FROM raw)""")
def hub_first_ids(spark, d):
    e = hetero(spark, d)
    return ids.sequential_train_ids(e, ids.top_degree(e, 50))


_SLOT = {0: 2, 1: 0, 2: 3, 3: 1}


@query(f"""{KG}, {BUCKETS}, sl AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _SLOT.items())}) t(part, slot))
SELECT edge_id, a.slot * {PSIZE} + src - src_part * {PSIZE} AS src_slot, b.slot * {PSIZE} + dst - dst_part * {PSIZE} AS dst_slot FROM bk JOIN sl a ON a.part = src_part JOIN sl b ON b.part = dst_part""")
def resident_slots(spark, d):
    e, n = kg(spark, d)
    rows = partition.with_buckets(e, n, PARTS).filter(F.col("src_part").isin(list(_SLOT)) & F.col("dst_part").isin(list(_SLOT)))
    slots, size = F.create_map(*[F.lit(x) for pair in _SLOT.items() for x in pair]), partition.partition_size(n, PARTS)
    return rows.select("edge_id", *[partition.resident_slot(F.col(c), slots, size, n, PARTS).alias(f"{c}_slot") for c in ("src", "dst")])


@query(f"""{KG} SELECT unnest(['src_null', 'src_range', 'rel_range', 'qval_negative', 'dst_below_100']) AS rule,
unnest([count_if(src IS NULL), count_if(src < 0 OR src >= (SELECT n FROM n)), count_if(rel < 0 OR rel >= 7), count_if(qval < 0), count_if(dst >= 100)])::BIGINT AS bad FROM kg""")
def edge_checks(spark, d):
    e, n = kg(spark, d, False)
    rules = {"src_null": checks.not_null("src"), "src_range": checks.in_range("src", 0, n), "rel_range": checks.in_range("rel", 0, 7), "qval_negative": checks.not_negative("qval"), "dst_below_100": checks.in_range("dst", 0, 100)}
    return checks.violations(e, rules)


for _side in ("src", "dst"):
    QUERIES[f"bucket_order_{_side}"] = lambda spark, d, s=_side: (lambda e, n: partition.ordered_in_bucket(partition.with_buckets(e, n, PARTS), s).select("edge_id", F.col("place").cast("bigint").alias("place")))(*kg(spark, d))
    SQL[f"bucket_order_{_side}"] = f"WITH {KG}, {BUCKETS} SELECT edge_id, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY {_side}, edge_id) - 1 AS place FROM bk"


@query(f"{KG} SELECT edge_id, (edge_id % 10 = 0)::INT AS added, row_number() OVER (ORDER BY src, edge_id % 10 = 0, edge_id) - 1 AS place FROM kg")
def merge_sorted_delta(spark, d):
    e, _ = kg(spark, d)
    return partition.merge_sorted(e.filter("edge_id % 10 <> 0"), e.filter("edge_id % 10 = 0"), "src").select("edge_id", "added", "place")


@query(f"{KG}, {BUCKETS}, r AS (SELECT edge_id, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY edge_id) - 1 AS k FROM bk) SELECT edge_id FROM r WHERE k % 8 = 0")
def stride_sample(spark, d):
    e, n = kg(spark, d)
    return partition.every_nth(partition.with_buckets(e, n, PARTS), 8).select("edge_id")


@query(f"{KG} SELECT node_id, n, row_number() OVER (ORDER BY node_id) - 1 AS place FROM (SELECT node_id, count(*) AS n FROM (SELECT unnest([src, dst]) AS node_id FROM kg) GROUP BY ALL)")
def unique_counts_sorted(spark, d):
    counts = kg(spark, d, False)[0].select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return number_rows(counts, by_value(counts, "node_id"), ["node_id"], "place")


# ---- more of negatives and scores ------------------------------------------------------------------------------------------


@query(f"""{KG}, {CHUNKED}, bs AS (SELECT batch_id, count(*) AS rows FROM ch GROUP BY ALL),
bp AS (SELECT batch_id, pos.range::INT AS pos, {draw_sql(15, "batch_id", "pos.range", "rows")} AS batch_row, {h_sql(16, "batch_id", "pos.range")} % 2 AS u FROM bs, range(50) pos)
SELECT batch_id, pos, edge_id, CASE WHEN u = 0 THEN src ELSE dst END AS node FROM bp JOIN ch USING (batch_id, batch_row)""")
def batch_endpoint_sample(spark, d):
    return negatives.batch_sample(chunked(spark, d)[0], 50)


def _both_ranks(spark, d):
    e, n = chunked(spark, d)
    emb, _ = nodes(spark, d)
    inverse = emb.filter("vec_id BETWEEN 7 AND 13").select((F.col("vec_id") - 7).cast("int").alias("vec_id"), "embedding")
    return scoring.both_side_ranks(e, negatives.uniform(e, NEGATIVES, n), emb, relations(emb), inverse, e)


@query(f"""{KG}, {EMB}, iv AS (SELECT vec_id - 7 AS rel, e AS rv FROM emb WHERE vec_id BETWEEN 7 AND 13), {CHUNKED}, {_UNI},
p AS (SELECT edge_id, a.e AS s, rv AS r, b.e AS t, 'dst' AS side FROM kg JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst JOIN rl ON rl.rel = kg.rel
      UNION ALL SELECT edge_id, a.e, rv, b.e, 'src' FROM kg JOIN emb a ON a.vec_id = dst JOIN emb b ON b.vec_id = src JOIN iv ON iv.rel = kg.rel),
q AS (SELECT edge_id, side, {_HAD} AS q, list_inner_product({_HAD}, t) AS pos_score FROM p),
sc AS (SELECT edge_id, side, pos_score, list_inner_product(q, emb.e) AS score,
       CASE WHEN side = 'dst' THEN (ch.src, ch.rel, neg) IN (SELECT (src, rel, dst) FROM kg) ELSE (neg, ch.rel, ch.dst) IN (SELECT (src, rel, dst) FROM kg) END AS known
       FROM ch JOIN uni USING (batch_id, chunk) JOIN q USING (edge_id) JOIN emb ON vec_id = neg),
rk AS (SELECT edge_id, side, count_if(score >= pos_score AND NOT known) + 1 AS rank FROM sc GROUP BY ALL)
SELECT count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits_{k}" for k in scoring.HITS)} FROM rk""")
def lp_metrics_both_sides(spark, d):
    return scoring.metrics(_both_ranks(spark, d))


@query(f"""{KG}, {EMB}, c AS (SELECT edge_id, src, dst, pos.range::INT AS pos, {draw_sql(14, "edge_id", "pos.range", "7")} AS neg_rel FROM kg, range(3) pos),
p AS (SELECT edge_id, pos, neg_rel, a.e AS s, rv AS r, b.e AS t FROM c JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst JOIN rl ON rl.rel = neg_rel)
SELECT edge_id, pos, neg_rel, round(list_inner_product({_HAD}, t), 6) AS score FROM p""")
def score_relation_corruption(spark, d):
    e, emb = kg(spark, d)[0], nodes(spark, d)[0]
    return scoring.relation_scores(negatives.corrupt_relations(e, 3, 7), emb, relations(emb)).withColumn("score", F.round("score", 6))


@query(f"""{KG}, {EMB}, p AS (SELECT edge_id, a.e AS s, rv AS r, b.e AS t, c.e AS u FROM kg JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst JOIN emb c ON c.vec_id = qval JOIN rl ON rl.rel = kg.rel)
SELECT edge_id, round(list_sum(list_transform(range(1, 65), lambda i: s[i] * r[i] * u[i] * t[i])), 6) AS score FROM p""")
def score_qualified(spark, d):
    e, emb = kg(spark, d)[0], nodes(spark, d)[0]
    rows = scoring.edge_scores(e.select("edge_id", "src", "rel", "dst", "qval"), emb, relations(emb), qualifier="qval")
    return rows.select("edge_id", F.round("score", 6).alias("score"))


@query(f"""{KG}, {EMB}, {CHUNKED}, {_UNI}, sc AS (SELECT ch.edge_id, pos, neg, -round(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) ** 2)), 9) AS score
FROM ch JOIN uni USING (batch_id, chunk) JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = neg)
SELECT edge_id, pos, neg FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY score DESC, pos) AS k FROM sc) WHERE k <= 3""")
def select_l2_nearest(spark, d):
    e, n = chunked(spark, d)
    scored = scoring.selection_scores(e, negatives.uniform(e, NEGATIVES, n), nodes(spark, d)[0])
    return scoring.top_k(scored.withColumn("score", F.round("score", 9)), 3).select("edge_id", "pos", "neg")


@query("WITH v AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS s FROM embeddings) SELECT count(*) AS n, round(sum(s) * 0.005, 6) AS penalty, round(avg(s), 6) AS mean_norm FROM v")
def regularizer_norm(spark, d):
    return scoring.norms(nodes(spark, d)[0], coefficient=0.01)


# ---- more of layers --------------------------------------------------------------------------------------------------------


@query(f"""{KG}, {EMB}, m AS (SELECT dst AS node_id, unnest(e) AS v, unnest(range(64)) AS i FROM kg JOIN emb ON vec_id = src),
s AS (SELECT node_id, i, max(v) AS a FROM m GROUP BY ALL) SELECT node_id, list(round(a, 5) + 0.0 ORDER BY i) AS x FROM s GROUP BY ALL""")
def seg_max(spark, d):
    return _rounded(gnn.vector_max(gnn.messages(kg(spark, d, False)[0], _x(spark, d)), ["node_id"], "x", DIM))


@query("SELECT vec_id AS node_id, list_transform(embedding[17:24]::DOUBLE[], lambda v: round(v, 5) + 0.0) AS x FROM embeddings")
def layer_embedding_slice(spark, d):
    return _rounded(_x(spark, d).select("node_id", gnn.part_of("x", 16, 8).alias("x")))


_LIN = _weights(2, 6)


@query(f"""e AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT {[[float(v) for v in r] for r in _LIN]} AS w)
SELECT node_id, list_transform([1, 2], lambda k: round(greatest(list_inner_product(list_concat(e[33:64], e[1:32]), w[k]::DOUBLE[]) + 0.05::DOUBLE * k, 0), 5) + 0.0) AS x FROM e, w""")
def layer_linear_bias_relu(spark, d):
    x = _x(spark, d).select("node_id", gnn.part_of("x", 32, 32).alias("a"), gnn.part_of("x", 0, 32).alias("b"))
    return _rounded(x.select("node_id", gnn.finish(gnn.linear(_LIN, "a", "b"), np.array([0.05, 0.1]), "relu").alias("x")))


@query(f"""{KG}, {_X0}, {_TWO}, {_SAGE(8, 'x0', DIM, 1, 2, 'o')}, x1 AS (SELECT node_id, list_transform(x, lambda v: greatest(v + 0.01::DOUBLE, 0)) AS x FROM o), {_SAGE(4, 'x1', 8, 8, 8, 'p')}
SELECT node_id, list_transform(x, lambda v: round(1 / (1 + exp(-v)), 5) + 0.0) AS x FROM p""")
def encode_two_layers(spark, d):
    w = _weights(4, 8, 8)
    layers = [(lambda e, x: gnn.sage(e, x, DIM, _weights(8, 1), _weights(8, 2)), np.ones(8) * 0.01, "relu"), (lambda e, x: gnn.sage(e, x, 8, w, w), None, "sigmoid")]
    return _rounded(gnn.encode(kg(spark, d, False)[0], _x(spark, d), layers))


@query(f"""{KG}, {_X0}, {_TWO}, {_SAGE(8, 'x0', DIM, 1, 2, 'o')}, lab AS (SELECT vec_id AS node_id, label FROM embeddings WHERE label BETWEEN 0 AND 7),
s AS (SELECT node_id, label, x, list_max(x) AS m FROM o JOIN lab USING (node_id)), z AS (SELECT node_id, label, list_transform(x, lambda v: exp(v - m)) AS e FROM s),
g AS (SELECT node_id, list_transform(range(1, 9), lambda k: (e[k] / list_sum(e) - (label = k - 1)::INT) / n) AS g FROM z, (SELECT count(*) AS n FROM lab)),
i AS (SELECT node_id, g, x0.x, coalesce(a, {_zeros(DIM)}) AS a FROM g JOIN x0 USING (node_id) LEFT JOIN o_n USING (node_id)), kj AS (SELECT k.range::INT AS k, j.range::INT AS j FROM range(8) k, range({DIM}) j)
SELECT 'self' AS weight, k, j, round(sum(g[k + 1] * x[j + 1]), 6) + 0.0 AS g FROM i, kj GROUP BY ALL UNION ALL SELECT 'nbr', k, j, round(sum(g[k + 1] * a[j + 1]), 6) + 0.0 FROM i, kj GROUP BY ALL""")
def gnn_weight_gradients(spark, d):
    """Gradients of a layer's weights for node classification over all labelled nodes."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    found, _, _ = gnn_training.gradients(kg(spark, d, False)[0], _x(spark, d), labels, [gnn_training.Sage({"self": _weights(8, 1), "nbr": _weights(8, 2)})])
    rows = [(name, k, j, round(float(g), 6) + 0.0) for name, w in found[0].items() for (k, j), g in np.ndenumerate(w)]  # two matrices of 8 x 64
    return spark.createDataFrame(rows, "weight string, k int, j int, g double")


for _kind, _f in {"uniform": "u * 2 - 1", "normal": "sqrt(-2 * ln(u)) * cos(2 * pi() * u2)"}.items():
    QUERIES[f"init_{_kind}"] = lambda spark, d, k=_kind: nodes(spark, d)[0].select(F.col("vec_id").alias("node_id"), F.posexplode(optim.initialise(k, 4, "vec_id")).alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)
    SQL[f"init_{_kind}"] = f"WITH k AS (SELECT vec_id AS node_id, k.range::INT AS i, ({h_sql(3, 'vec_id', 'k.range')} + 0.5::DOUBLE) / {M} AS u, ({h_sql(4, 'vec_id', 'k.range')} + 0.5::DOUBLE) / {M} AS u2 FROM embeddings, range(4) k) SELECT node_id, i, round({_f}, 6) + 0.0 AS x FROM k"


# ---- more of schedules and analyzers -----------------------------------------------------------------------------------------


@query(f"""{SWAP}, a AS (SELECT lane, superstep, part FROM sch), b AS (SELECT lane, superstep + 1 AS superstep, part FROM sch)
SELECT *, 'admit' AS move FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
SELECT *, 'evict' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE (lane, superstep) IN (SELECT (lane, superstep) FROM a)""")
def lane_admit_evict(spark, d):
    return analyze.lane_moves(_sched(spark, SWAPS))


@query(f"{SCHED}, s AS (SELECT state, list(part) AS p FROM sch GROUP BY ALL) SELECT a.state AS a, b.state AS b FROM s a JOIN s b ON a.state < b.state AND NOT list_has_any(a.p, b.p)")
def compatible_states(spark, d):
    return analyze.compatible_states(_sched(spark))


@query(f"""{SWAP}, st AS (SELECT DISTINCT superstep, state FROM sch), pr AS (SELECT a.superstep, (SELECT count(*) FROM sch x JOIN sch y ON x.part = y.part WHERE x.state = a.state AND y.state = b.state) AS overlap
FROM st a JOIN st b ON a.superstep = b.superstep AND a.state < b.state)
SELECT superstep, count(*) AS pairs, sum(overlap)::BIGINT AS total, max(overlap) AS worst, round(avg(overlap), 6) AS mean, count_if(overlap > 0) AS conflicts FROM pr GROUP BY ALL""")
def superstep_overlap_stats(spark, d):
    return analyze.overlap_stats(analyze.pair_overlap(_sched(spark, SWAPS)))


@query(f"SELECT a.range::INT AS a, b.range::INT AS b, 1::BIGINT AS states FROM range({PARTS}) a JOIN range({PARTS}) b ON a.range < b.range")
def schedule_pair_states(spark, d):
    """Every pair of partitions meets in exactly one state of the disjoint rounds."""
    s = _sched(spark).select("state", "part")
    pairs = s.withColumnRenamed("part", "a").join(s.withColumnRenamed("part", "b"), "state").filter("a < b")
    return pairs.groupBy(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).agg(F.count(F.lit(1)).alias("states"))


@query(f"""{STATED}, ac AS (SELECT state, entity, count(*) AS n FROM (SELECT state, unnest([src, dst]) AS entity FROM se) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, entity) AS r, greatest(1, floor(count(*) OVER (PARTITION BY state) * 0.1::DOUBLE))::BIGINT AS k FROM ac)
SELECT state, max(k) AS entities, round(sum(CASE WHEN r <= k THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM rk GROUP BY ALL""")
def top_share_coverage(spark, d):
    return analyze.top_share_coverage(analyze.access_counts(_state_edges(spark, d)), 0.1)


SKETCH = 64
_KMV = f"""{KG}, t AS (SELECT DISTINCT edge_id // {BATCH} AS batch_id, {h_sql(21, "node")} AS hash FROM (SELECT edge_id, unnest([src, dst]) AS node FROM kg)),
kmv AS (SELECT batch_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY hash) AS r FROM t) WHERE r <= {SKETCH})"""


def _sketches(spark, d):
    return analyze.smallest_hashes(partition.batches(kg(spark, d)[0], BATCH), "batch_id", SKETCH)


@query(f"{_KMV} SELECT batch_id, CASE WHEN count(*) < {SKETCH} THEN count(*)::DOUBLE ELSE round({SKETCH - 1} * {M}::DOUBLE / max(hash), 4) END AS estimate FROM kmv GROUP BY ALL")
def sketch_estimate(spark, d):
    return analyze.estimate_distinct(_sketches(spark, d), "batch_id", SKETCH)


@query(f"""{_KMV}, m AS (SELECT DISTINCT batch_id // 4 AS grp, hash FROM kmv), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hash) AS r FROM m) WHERE r <= {SKETCH})
SELECT grp, CASE WHEN count(*) < {SKETCH} THEN count(*)::DOUBLE ELSE round({SKETCH - 1} * {M}::DOUBLE / max(hash), 4) END AS estimate FROM k GROUP BY ALL""")
def sketch_merge(spark, d):
    merged = analyze.merge_sketches(_sketches(spark, d).select(F.floor(F.col("batch_id") / 4).alias("grp"), "hash"), "grp", SKETCH)
    return analyze.estimate_distinct(merged, "grp", SKETCH)


@query(f"""{_KMV}, s AS (SELECT batch_id, count(*) AS n FROM kmv GROUP BY ALL), o AS (SELECT a.batch_id, count(*) AS shared FROM kmv a JOIN kmv b ON b.batch_id = a.batch_id + 1 AND b.hash = a.hash GROUP BY ALL)
SELECT a.batch_id, round(coalesce(shared, 0) / least(a.n, b.n), 6) AS similarity FROM s a JOIN s b ON b.batch_id = a.batch_id + 1 LEFT JOIN o ON o.batch_id = a.batch_id""")
def sketch_similarity(spark, d):
    return analyze.sketch_overlap(_sketches(spark, d), "batch_id")


@query("r AS (SELECT user_id % 50 AS round, user_id % 4 AS lane, count(*) AS ms FROM events GROUP BY ALL), m AS (SELECT round, max(ms) AS ms FROM r GROUP BY ALL) SELECT sum(ms)::BIGINT AS epoch_ms FROM m")
def predicted_epoch(spark, d):
    rounds = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("round"), (F.col("user_id") % 4).alias("lane")).agg(F.count(F.lit(1)).alias("ms"))
    return analyze.predicted_epoch(rounds)


@query("""s AS (SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS b, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS o FROM events GROUP BY ALL)
SELECT event_type, round(b, 6) AS base, round(o, 6) AS other, round(100 * (o - b) / b, 4) AS change FROM s""")
def percent_change(spark, d):
    return analyze.percent_change(table(spark, d, "events").withColumn("side", F.col("user_id") % 2), "value", "side", 0, 1, ("event_type",))


_ORDERINGS = {
    "swap": lambda: SWAPS,
    "two_level": lambda: schedule.two_level_ordering(PARTS, 4, 2),
    "relabelled": lambda: [s for r in schedule.relabelled(schedule.disjoint_rounds(PARTS), 3) for s in r],
    "overlap": lambda: schedule.overlap_order(STATES),
    "grouped": lambda: schedule.group_disjoint(STATES[::5] + STATES[1::5] + STATES[2::5] + STATES[3::5] + STATES[4::5], DEVICES, strict=True),
    "coverage": lambda: schedule.coverage_order(STATES, DEVICES),
    "access": lambda: schedule.access_order(STATES, DEVICES),
    "old_beta": lambda: schedule.ordered(schedule.Ordering("old_beta", PARTS))[0],
    "comet": lambda: schedule.ordered(schedule.Ordering("comet", PARTS, 4, fine_per_coarse=2, random_owner=True))[0],
    "custom_devices": lambda: schedule.ordered(schedule.Ordering("custom", PARTS, 4, devices=DEVICES))[0],
}


def _facts_sql(states) -> str:
    """The planner's states, and what their order does in SQL."""
    return f"""WITH sch AS (SELECT state, part, state // {DEVICES} AS superstep FROM {schedule.as_values(states)}),
k AS (SELECT a.state, count(*) AS kept FROM sch a JOIN sch b ON b.state = a.state - 1 AND b.part = a.part GROUP BY ALL),
f AS (SELECT a.part AS pa, b.part AS pb, min(a.state) AS state FROM sch a JOIN sch b ON a.state = b.state AND a.part < b.part GROUP BY ALL), m AS (SELECT state, count(*) AS new_pairs FROM f GROUP BY ALL),
c AS (SELECT a.state, count(*) AS clashes FROM sch a JOIN sch b ON a.superstep = b.superstep AND a.state <> b.state AND a.part = b.part GROUP BY ALL)
SELECT s.state, list(s.part ORDER BY s.part) AS parts, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(new_pairs), 0) AS new_pairs, coalesce(any_value(clashes), 0) AS clashes
FROM sch s LEFT JOIN k USING (state) LEFT JOIN m USING (state) LEFT JOIN c USING (state) GROUP BY s.state"""


for _name, _states in _ORDERINGS.items():
    QUERIES[f"schedule_{_name}"] = lambda spark, d, f=_states: analyze.order_facts(_sched(spark, f()))
    SQL[f"schedule_{_name}"] = _facts_sql(_states())


def _bucket_table(spark, d) -> list[list[int]]:
    e, n = kg(spark, d, False)
    sizes = [[0] * PARTS for _ in range(PARTS)]
    for r in partition.bucket_sizes(e, n, PARTS).collect():  # parts x parts rows
        sizes[r["src_part"]][r["dst_part"]] = r["edges"]
    return sizes


@query()
def schedule_balanced(spark, d):
    """States, facts and weights of the rounds that are balanced by the table's bucket sizes."""
    e, n = kg(spark, d, False)
    s = _sched(spark, schedule.ordered(schedule.Ordering("custom", PARTS, 4, optimised=True), _bucket_table(spark, d))[0])
    return analyze.order_facts(s).join(analyze.state_weight(s, partition.bucket_sizes(e, n, PARTS)), "state")


@query()
def schedule_hot(spark, d):
    """States in the order of shared hotness for one device."""
    return analyze.order_facts(_sched(spark, schedule.hot_order(STATES, _bucket_table(spark, d))))


@query(f"""{KG}, {BUCKETS} SELECT edge_id, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY {h_sql(23, 'edge_id')}, edge_id) - 1 AS place FROM bk""")
def bucket_shuffle(spark, d):
    e, n = kg(spark, d)
    return partition.shuffled_in_bucket(partition.with_buckets(e, n, PARTS), 23).select("edge_id", "place")


@query(f"""{KG}, sch AS (SELECT state, part FROM {schedule.as_values(schedule.node_ordering(PARTS, 4))}), np AS (SELECT vec_id AS node_id, (vec_id // {PSIZE})::INT AS part FROM embeddings)
SELECT node_id, np.part, state FROM np JOIN sch USING (part)""")
def node_states_dispersed(spark, d):
    """Nodes of a dispersed node ordering: its states are disjoint, so each node has one."""
    emb, n = nodes(spark, d)
    rows = emb.select(F.col("vec_id").alias("node_id"), partition.partition_of("vec_id", n, PARTS).alias("part"))
    return analyze.assign_nodes(rows, schedule.as_table(spark, schedule.node_ordering(PARTS, 4)))


@query(f"""{KG}, {SCHED}, np AS (SELECT vec_id AS node_id, (vec_id // {PSIZE})::INT AS part FROM embeddings), h AS (SELECT part, list(state ORDER BY state) AS s FROM sch GROUP BY ALL)
SELECT node_id, np.part, s[({h_sql(31, 'node_id')} % len(s) + 1)::BIGINT] AS state FROM np JOIN h USING (part)""")
def node_states_random(spark, d):
    """Nodes of an ordering whose states overlap: one of those that hold the node's partition."""
    emb, n = nodes(spark, d)
    rows = emb.select(F.col("vec_id").alias("node_id"), partition.partition_of("vec_id", n, PARTS).alias("part"))
    return analyze.assign_nodes(rows, _sched(spark).select("state", "part"))


@query("""WITH s AS (SELECT event_type, value FROM events), p AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p),
g AS (SELECT event_type, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v FROM s GROUP BY ALL)
SELECT event_type, p, v[greatest(1, ceil(p * len(v)))::BIGINT]::DOUBLE AS nearest,
       round(v[floor(p * (len(v) - 1))::BIGINT + 1] + (v[least(len(v), floor(p * (len(v) - 1))::BIGINT + 2)] - v[floor(p * (len(v) - 1))::BIGINT + 1]) * (p * (len(v) - 1) - floor(p * (len(v) - 1))), 6) AS interpolated FROM g, p""")
def sample_percentiles(spark, d):
    return analyze.percentiles(table(spark, d, "events"), "value", (0.5, 0.9, 0.99), ("event_type",)).withColumn("interpolated", F.round("interpolated", 6))


@query(f"""{KG}, {CHUNKED} SELECT batch_id, chunk, pos, {draw_sql(11, f'(batch_id // 4) * {negatives.CHUNKS} + chunk', 'pos', 'SELECT n FROM n')} AS neg FROM plan""")
def neg_pooled(spark, d):
    e, n = chunked(spark, d)
    return negatives.pooled(e, NEGATIVES, n, 4)


@query(f"""{KG}, {EMB}, c AS (SELECT emb.vec_id, label, list(list_inner_product(emb.e, rv) ORDER BY rl.rel) AS l FROM emb, rl GROUP BY ALL)
SELECT vec_id AS node_id, round(ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[(label + 1)::BIGINT], 6) + 0.0 AS loss FROM c""")
def loss_cross_entropy(spark, d):
    """Seven logits a node, the label as their class; a label beyond them has no loss."""
    emb, _ = nodes(spark, d)
    rel = relations(emb).orderBy("vec_id").select(F.col("embedding").cast("array<double>")).collect()  # seven rows
    logits = F.array(*[V.dot(F.col("e"), F.array(*[F.lit(x) for x in r[0]])) for r in rel])
    rows = emb.select("vec_id", "label", V.doubles("embedding").alias("e")).select(F.col("vec_id").alias("node_id"), "label", logits.alias("logits"))
    return scoring.cross_entropy(rows).select("node_id", (F.round("loss", 6) + 0.0).alias("loss"))


for _name in ("softmax_ce", "mse", "ranking"):
    for _reduction in ("sum", "mean"):
        _terms = {"softmax_ce": "1", "mse": "k + 1", "ranking": "k"}[_name]
        QUERIES[f"reduced_{_name}_{_reduction}"] = lambda spark, d, a=_name, b=_reduction: scoring.reduced(scoring.losses(scored_negatives(spark, d)), a, b).select(F.round("loss", 4).alias("loss"))
        SQL[f"reduced_{_name}_{_reduction}"] = f"WITH {_SC}, e AS (SELECT {_LOSS[_name]} AS l, count(score) AS k FROM sc GROUP BY edge_id) SELECT round(sum(l)::DOUBLE{f' / sum({_terms})' if _reduction == 'mean' else ''}, 4) AS loss FROM e"
