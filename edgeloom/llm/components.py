"""Connected components by alternating large-star and small-star steps, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialise, salted_left_join

#: Tasks over which the neighbours of a node are spread.
SALTS = 8


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``links`` (a, b) of any orderable type -> (node, root): the smallest node reachable; roots have no row of their own.

    The number of links never grows.  A node with very many links is pre-aggregated by ``min`` before the shuffle and
    its neighbours are spread over ``SALTS`` tasks in the join.  Only a count and a checksum of each round come to the driver.  Self links and
    links with null are ignored; no links give no rows.
    """
    edges = materialise(_oriented(links.select("a", "b")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = materialise(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if state[0]:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    """a > b."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return salted_left_join(both, least, "a", F.col("b"), SALTS).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted_left_join(edges, least, "a", F.col("b"), SALTS).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
