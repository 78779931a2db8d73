"""Degrees, neighbours and k-hop sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import M, h
from edgeloom.functions.work import materialise


def degrees(edges: DataFrame) -> DataFrame:
    """``node_id, out_degree, in_degree``: one pass, pre-aggregated before the shuffle, so hubs do not hurt."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def partition_hotness(buckets: DataFrame) -> DataFrame:
    """Edges that touch a partition; self buckets count once."""
    sides = buckets.select(F.explode(F.array("src_part", "dst_part")).alias("part"), "src_part", "dst_part", "edges")
    weight = F.when(F.col("src_part") == F.col("dst_part"), F.col("edges") / 2).otherwise(F.col("edges").cast("double"))
    return sides.groupBy("part").agg(F.sum(weight).cast("bigint").alias("hotness"))


def neighbours(nodes: DataFrame, edges: DataFrame, incoming: bool) -> DataFrame:
    """``node_id, nbr, rel, edge_id`` of the nodes' in- or out-edges."""
    at, to = ("dst", "src") if incoming else ("src", "dst")
    return edges.select(F.col(at).alias("node_id"), F.col(to).alias("nbr"), "rel", "edge_id").join(nodes.select("node_id").distinct(), "node_id", "left_semi")


#: Parts into which the edges of a node are cut before the last choice of a uniform sample, so that no task sorts all of a hub's.
PARTS = 32


def sample(found: DataFrame, method: str = "all", limit: int = 10, rate: float = 0.5, seed: int = 1) -> DataFrame:
    """``all``; ``uniform``: at most ``limit`` per node without replacement; ``dropout``: keep an edge if its draw >= rate."""
    if method == "uniform":
        rows = found.withColumn("__h", h(seed, "edge_id", "node_id")).withColumn("__part", F.pmod(F.col("edge_id"), F.lit(PARTS)))
        for own in (["node_id", "__part"], ["node_id"]):  # the least of a node are among the least of its parts
            first = Window.partitionBy(*own).orderBy("__h", "edge_id", "nbr")
            rows = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= limit)
        return rows.drop("__h", "__part", "__n")
    return found.filter(h(seed, "edge_id", "node_id") >= int(rate * M)) if method == "dropout" else found


def khop(seeds: DataFrame, edges: DataFrame, hops: int, method: str = "all", limit: int = 10, rate: float = 0.5, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """``hop, node_id`` (and ``by``): hop 0 are the seeds, hop k the nodes first reached by step k over in- and out-edges of hop k - 1.

    With ``by`` columns (a batch of seeds) every batch has its own hops; a node's sampled neighbours are the same in all.
    Each hop is written to the shared work folder, so the plan does not grow with the hops and a lost executor costs one hop.
    """
    key = [*by, "node_id"]
    frontier = materialise(seeds.select(*key).distinct())
    seen = frontier.withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        both = neighbours(frontier, edges, False).unionByName(neighbours(frontier, edges, True))
        drawn = sample(both, method, limit, rate, seed + k).select("node_id", "nbr").distinct()
        reached = frontier.join(drawn, "node_id").select(*by, F.col("nbr").alias("node_id")).distinct()
        frontier = materialise(reached.join(seen, key, "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(k)))
    return seen
