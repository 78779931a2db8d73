"""Neighbourhood aggregation layers (forward) over ``edges`` (src, rel, dst) and ``x`` (node_id, x: array<double>)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import vectors as V
from edgeloom.functions.work import materialise
from edgeloom.operators import graph


def vector_sum(rows: DataFrame, key: list[str], vector: str, dim: int, name: str = "x", mean: bool = False) -> DataFrame:
    """Element-wise sum (or mean) by key as ``dim`` ordinary aggregates: partial sums before the shuffle, also for hubs."""
    f = F.avg if mean else F.sum
    sums = rows.groupBy(*key).agg(*[f(F.col(vector)[i]).alias(f"__{i}") for i in range(dim)])
    return sums.select(*key, F.array(*[F.col(f"__{i}") for i in range(dim)]).alias(name))


def messages(edges: DataFrame, x: DataFrame, incoming: bool = True) -> DataFrame:
    """``node_id, nbr, rel, x`` of the neighbours."""
    at, to = ("dst", "src") if incoming else ("src", "dst")
    return edges.select(F.col(at).alias("node_id"), F.col(to).alias("nbr"), "rel").join(x.select(F.col("node_id").alias("nbr"), "x"), "nbr")


def matmul(vector: str | Column, weights: np.ndarray) -> Column:
    """x W^T by an Arrow function; the weights are a small parameter of the model."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def run(v):
        return pd.Series(list(np.array(v.tolist()).reshape(len(v), -1) @ weights.T))

    return run(vector)


def sage(edges: DataFrame, x: DataFrame, dim: int, w_self: np.ndarray, w_nbr: np.ndarray | None = None, kind: str = "mean") -> DataFrame:
    """mean: W1 x + W2 mean(in- and out-neighbours); gcn: W1 (sum + x) / (degree + 1).  Nodes without neighbours keep W1 x."""
    both = messages(edges, x, True).unionByName(messages(edges, x, False))
    zero = F.array(*[F.lit(0.0)] * dim)
    if kind == "mean":
        agg = vector_sum(both, ["node_id"], "x", dim, "a", mean=True)
        rows = x.join(agg, "node_id", "left").withColumn("a", F.coalesce("a", zero))
        return rows.select("node_id", V.add(matmul("x", w_self), matmul("a", w_nbr)).alias("x"))
    agg = vector_sum(both, ["node_id"], "x", dim, "a").join(both.groupBy("node_id").agg(F.count(F.lit(1)).alias("d")), "node_id")
    rows = x.join(agg, "node_id", "left").withColumn("a", F.coalesce("a", zero)).withColumn("d", F.coalesce("d", F.lit(0)))
    return rows.withColumn("y", V.scale(V.add(F.col("a"), F.col("x")), 1 / (F.col("d") + 1))).select("node_id", matmul("y", w_self).alias("x"))


def gcn_norm(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` = 1 / sqrt((deg(src) + 1) (deg(dst) + 1)) with in-degrees."""
    d = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    rows = edges.join(d.select(F.col("node_id").alias("src"), F.col("d").alias("ds")), "src", "left").join(d.select(F.col("node_id").alias("dst"), F.col("d").alias("dd")), "dst")
    return rows.withColumn("weight", 1 / F.sqrt((F.coalesce("ds", F.lit(0)) + 1.0) * (F.col("dd") + 1.0)))


def gcn(edges: DataFrame, x: DataFrame, dim: int, weights: np.ndarray) -> DataFrame:
    d = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    normed = x.join(d, "node_id", "left").withColumn("x", V.scale(F.col("x"), 1 / F.sqrt(F.coalesce("d", F.lit(0)) + 1.0)))
    agg = vector_sum(messages(edges, normed.select("node_id", "x")), ["node_id"], "x", dim, "a")
    rows = normed.join(agg, "node_id", "left").withColumn("s", V.add(F.coalesce("a", F.array(*[F.lit(0.0)] * dim)), F.col("x")))
    return rows.withColumn("s", V.scale(F.col("s"), 1 / F.sqrt(F.coalesce("d", F.lit(0)) + 1.0))).select("node_id", matmul("s", weights).alias("x"))


def attention(scored: DataFrame, key: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """``scored`` (key, ..., logit; a self row has nbr = node_id) with ``alpha``, the stable softmax by key.

    Two pre-aggregated passes (max, sum) and joins instead of a window, so that a hub's rows are not sorted in one task.
    """
    top = scored.groupBy(*key).agg(F.max("logit").alias("m"))
    rows = scored.join(top, list(key)).withColumn("e", F.exp(F.col("logit") - F.col("m")))
    return rows.join(rows.groupBy(*key).agg(F.sum("e").alias("z")), list(key)).withColumn("alpha", F.col("e") / F.col("z")).drop("m", "e", "z")


def gat(edges: DataFrame, x: DataFrame, dim: int, heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]], slope: float = 0.2, average: bool = False) -> DataFrame:
    """Attention over the in-neighbours and the node itself; ``heads`` are (weights, self vector, neighbour vector) of equal shapes.

    The heads' results are concatenated, or averaged.  All heads share one pass over the edges."""
    out = heads[0][0].shape[0]
    lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
    z = x.select("node_id", matmul("x", np.concatenate([w for w, _, _ in heads])).alias("x"))
    part = lambda k: F.slice("x", k * out + 1, out)
    own = z.select("node_id", F.array(*[V.dot(part(k), lit(a)) for k, (_, a, _) in enumerate(heads)]).alias("own"))
    rows = messages(edges, z).select("node_id", "nbr", "x").unionByName(z.select("node_id", F.col("node_id").alias("nbr"), "x")).join(own, "node_id")
    each = [F.struct(F.lit(k).alias("head"), part(k).alias("x"), (F.col("own")[k] + V.dot(part(k), lit(b))).alias("raw")) for k, (_, _, b) in enumerate(heads)]
    rows = rows.select("node_id", "nbr", F.explode(F.array(*each)).alias("h")).select("node_id", "nbr", "h.*")
    key = ("node_id", "head")
    rows = attention(rows.withColumn("logit", F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("raw") * slope)), key)
    sums = vector_sum(rows.withColumn("x", V.scale(F.col("x"), F.col("alpha"))), list(key), "x", out)
    if average:
        return vector_sum(sums, ["node_id"], "x", out, mean=True)
    return sums.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("head", "x"))).alias("h")).select("node_id", F.flatten("h.x").alias("x"))


def rgcn(edges: DataFrame, x: DataFrame, dim: int, w_rel: dict[int, np.ndarray], w_self: np.ndarray) -> DataFrame:
    """Mean over out-edges of W_rel x_nbr, plus W_self x.  A relation without weights raises.

    Neighbours are summed by node and relation first (with partial sums, also for hubs), so each such sum is multiplied once."""
    out = w_self.shape[0]
    rows = messages(edges, x, False)
    sums = vector_sum(rows, ["node_id", "rel"], "x", dim, "s").join(rows.groupBy("node_id", "rel").agg(F.count(F.lit(1)).alias("n")), ["node_id", "rel"])
    shared = x.sparkSession.sparkContext.broadcast(w_rel)

    @F.pandas_udf("array<double>")
    def times(rel, s):
        import pandas as pd

        v, r, got = np.array(s.tolist()).reshape(len(s), -1), rel.to_numpy(), np.zeros((len(s), out))
        for k in np.unique(r):
            if k not in shared.value:
                raise ValueError(f"no weights for relation {k}")
            got[r == k] = v[r == k] @ shared.value[k].T
        return pd.Series(list(got))

    moved = sums.select("node_id", "n", times("rel", "s").alias("y"))
    agg = vector_sum(moved, ["node_id"], "y", out, "a").join(moved.groupBy("node_id").agg(F.sum("n").alias("n")), "node_id")
    joined = x.join(agg, "node_id", "left").withColumn("a", F.coalesce(V.scale(F.col("a"), 1 / F.col("n")), F.array(*[F.lit(0.0)] * out)))
    return joined.select("node_id", V.add(matmul("x", w_self), F.col("a")).alias("x"))


def concat(*columns: str) -> Column:
    return F.concat(*columns)


def vector_max(rows: DataFrame, key: list[str], vector: str, dim: int, name: str = "x") -> DataFrame:
    """Element-wise maximum by key, pre-aggregated; keys without rows have none (fill with zeros after a left join)."""
    tops = rows.groupBy(*key).agg(*[F.max(F.col(vector)[i]).alias(f"__{i}") for i in range(dim)])
    return tops.select(*key, F.array(*[F.col(f"__{i}") for i in range(dim)]).alias(name))


def part_of(vector: str, offset: int, dim: int) -> Column:
    """Embedding layer: ``dim`` elements of a stored vector from ``offset`` (0 based)."""
    return F.slice(vector, offset + 1, dim)


def linear(weights: np.ndarray, *columns: str) -> Column:
    """Reduction layer: W times the concatenated columns."""
    return matmul(concat(*columns), weights)


def finish(vector: Column, bias: np.ndarray | None = None, activation: str = "none") -> Column:
    """Bias and activation (none, relu, sigmoid) after a layer."""
    out = vector if bias is None else V.add(vector, F.array(*[F.lit(float(b)) for b in bias]))
    return {"none": V.no_op(out, None), "relu": V.relu(out), "sigmoid": V.sigmoid(out)}[activation]


def encode(edges: DataFrame, x: DataFrame, layers: list) -> DataFrame:
    """All nodes through a stack of layers.

    A layer is (f, bias, activation) with f: (edges, x) -> (node_id, x).  A layer's output is the next one's input, so each
    layer is one aggregation over the edges for all nodes, not a sampled tree for every batch.
    """
    for f, bias, activation in layers:
        x = f(edges, x).select("node_id", finish(F.col("x"), bias, activation).alias("x"))
    return x


def encode_sampled(seeds: DataFrame, edges: DataFrame, x: DataFrame, layers: list, method: str = "all", limit: int = 10, rate: float = 0.5, seed: int = 1) -> DataFrame:
    """``node_id, x`` of ``seeds`` (node_id) through a stack of layers over their sampled neighbourhood; ``edges`` have edge_id.

    Hop k samples the in- and out-edges of the nodes that hop k - 1 reached.  The first layer uses the edges of all hops and each
    further one drops the outermost hop; a layer's output is kept for the nodes that later layers need."""
    reached = materialise(seeds.select("node_id").distinct()).withColumn("hop", F.lit(0))
    frontier, sampled = reached.select("node_id"), []
    for k in range(len(layers)):
        both = [graph.neighbours(frontier, edges, incoming).withColumn("incoming", F.lit(incoming)) for incoming in (True, False)]
        drawn = graph.sample(both[0].unionByName(both[1]), method, limit, rate, seed + k)
        found = materialise(drawn.select("edge_id", "rel", "incoming", "node_id", "nbr").distinct())
        sampled.append(found)
        frontier = materialise(found.select(F.col("nbr").alias("node_id")).distinct().join(reached, "node_id", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(k + 1)))
    for depth, (f, bias, activation) in zip(range(len(layers) - 1, -1, -1), layers):
        used = sampled[0]
        for found in sampled[1 : depth + 1]:
            used = used.unionByName(found)
        used = used.select("edge_id", "rel", F.when(F.col("incoming"), F.col("nbr")).otherwise(F.col("node_id")).alias("src"), F.when(F.col("incoming"), F.col("node_id")).otherwise(F.col("nbr")).alias("dst")).distinct()
        needed = reached.filter(F.col("hop") <= depth).select("node_id")
        x = f(used, x.join(reached.select("node_id"), "node_id", "left_semi")).join(needed, "node_id", "left_semi")
        x = materialise(x.select("node_id", finish(F.col("x"), bias, activation).alias("x")))
    return x
