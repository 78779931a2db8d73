"""Analyzers of schedules and access patterns: overlap, hand-off, coverage, residency, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import M, h
from edgeloom.functions.ranking import number_in_groups


def lanes(states: DataFrame, devices: int) -> DataFrame:
    """Adds ``lane`` = state mod devices and ``superstep`` = state div devices."""
    return states.withColumn("lane", (F.col("state") % devices).cast("int")).withColumn("superstep", F.floor(F.col("state") / devices))


def pair_overlap(schedule: DataFrame) -> DataFrame:
    """``superstep, a, b, overlap``: partitions shared by two states of a superstep."""
    x = schedule.select("superstep", F.col("state").alias("a"), "part")
    y = schedule.select("superstep", F.col("state").alias("b"), "part")
    shared = x.join(y, ["superstep", "part"]).filter("a < b").groupBy("superstep", "a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    s = schedule.select("superstep", "state").distinct()
    pairs = s.withColumnRenamed("state", "a").join(s.withColumnRenamed("state", "b"), "superstep").filter("a < b")
    return pairs.join(shared, ["superstep", "a", "b"], "left").na.fill(0, ["overlap"])


def handoff(schedule: DataFrame, horizon: int) -> DataFrame:
    """``lane, state, part, retained, used_later``: of the partitions that a lane holds, whether its next state keeps them and
    whether any lane uses them within ``horizon`` supersteps."""
    nxt = schedule.select("lane", (F.col("superstep") - 1).alias("superstep"), "part").withColumn("retained", F.lit(True))
    steps = schedule.select("part", "superstep").distinct()
    own = Window.partitionBy("part").orderBy("superstep").rangeBetween(1, horizon)
    later = steps.withColumn("used_later", F.count(F.lit(1)).over(own) > 0)
    out = schedule.join(nxt, ["lane", "superstep", "part"], "left").join(later, ["part", "superstep"])
    return out.select("lane", "state", "part", F.coalesce("retained", F.lit(False)).alias("retained"), "used_later")


def state_weight(schedule: DataFrame, buckets: DataFrame) -> DataFrame:
    """Edges of all buckets that are resident in a state."""
    a = schedule.select("state", F.col("part").alias("src_part"))
    b = schedule.select("state", F.col("part").alias("dst_part"))
    return a.join(b, "state").join(buckets, ["src_part", "dst_part"]).groupBy("state").agg(F.sum("edges").alias("weight"))


def first_owner(schedule: DataFrame) -> DataFrame:
    """``src_part, dst_part, state``: the first state that holds both partitions."""
    a = schedule.select("state", F.col("part").alias("src_part"))
    b = schedule.select("state", F.col("part").alias("dst_part"))
    return a.join(b, "state").groupBy("src_part", "dst_part").agg(F.min("state").alias("state"))


def random_owner(schedule: DataFrame, seed: int = 5) -> DataFrame:
    """As first_owner, but any of the states that hold both, by hash."""
    a = schedule.select("state", F.col("part").alias("src_part"))
    b = schedule.select("state", F.col("part").alias("dst_part"))
    both = a.join(b, "state").distinct()
    pick = F.min(F.struct(h(seed, F.col("src_part") * 65536 + F.col("dst_part"), "state").alias("k"), "state"))
    return both.groupBy("src_part", "dst_part").agg(pick["state"].alias("state"))


def access_counts(edges: DataFrame, key: str = "state") -> DataFrame:
    """``key, entity, n``: one access for each endpoint."""
    return edges.select(key, F.explode(F.array("src", "dst")).alias("entity")).groupBy(key, "entity").agg(F.count(F.lit(1)).alias("n"))


def top_k_coverage(counts: DataFrame, k: int, key: str = "state") -> DataFrame:
    """Share of a state's accesses that its k most accessed entities take (ties: smallest entity)."""
    rows = _by_access(counts, key)
    return rows.groupBy(key).agg(F.sum("n").alias("accesses"), F.round(F.sum(F.when(F.col("r") < k, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"))


def _by_access(counts: DataFrame, key: str) -> DataFrame:
    """``counts`` with ``r`` (from 0): the place of an entity in its group, most accessed first; numbered in slices of equal counts."""
    return number_in_groups(counts, [key], {"less": -F.col("n"), "ids": F.floor(F.col("entity") / (1 << 18))}, [F.col("n").desc(), "entity"], "r")


def history_coverage(counts: DataFrame, history: int, devices: int) -> DataFrame:
    """Share of a state's accesses to entities seen in the previous ``history`` states of its lane."""
    rows = lanes(counts, devices).withColumn("at", F.col("superstep"))
    past = rows.select("lane", "entity", F.explode(F.sequence(F.col("at") + 1, F.col("at") + history)).alias("at")).distinct().withColumn("seen", F.lit(True))
    out = rows.join(past, ["lane", "entity", "at"], "left")
    return out.groupBy("state").agg(F.sum("n").alias("accesses"), F.round(F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("seen_coverage"))


def residency_segments(schedule: DataFrame) -> DataFrame:
    """``lane, part, first_step, last_step, steps``: unbroken runs of supersteps in which a lane holds a partition."""
    own = Window.partitionBy("lane", "part").orderBy("superstep")
    rows = schedule.withColumn("island", F.col("superstep") - F.row_number().over(own))
    return rows.groupBy("lane", "part", "island").agg(F.min("superstep").alias("first_step"), F.max("superstep").alias("last_step"), F.count(F.lit(1)).alias("steps")).drop("island")


def revisit_gaps(schedule: DataFrame) -> DataFrame:
    """``part, visits, median_gap, max_gap``: supersteps from one use of a partition to the next, on any lane; the median is
    the upper middle."""
    own = Window.partitionBy("part").orderBy("superstep")
    gaps = schedule.select("part", "superstep").distinct().withColumn("gap", F.lead("superstep").over(own) - F.col("superstep"))
    agg = gaps.groupBy("part").agg(F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list("gap")).alias("g"), F.max("gap").alias("max_gap"))
    return agg.select("part", "visits", F.when(F.size("g") > 0, F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1)).alias("median_gap"), "max_gap")


def batch_touches(edges: DataFrame, key: str = "batch_id") -> DataFrame:
    """``touches, uniq, duplicate_ratio`` by batch."""
    agg = access_counts(edges, key).groupBy(key).agg(F.sum("n").alias("touches"), F.count(F.lit(1)).alias("uniq"))
    return agg.withColumn("duplicate_ratio", F.round(1 - F.col("uniq") / F.col("touches"), 6))


def chunk_fill(edges: DataFrame, chunk: int, num_nodes: int, key: str = "batch_id") -> DataFrame:
    """Distinct touched rows, touched chunks of ``chunk`` rows, their fill, and their share of all chunks."""
    rows = edges.select(key, F.explode(F.array("src", "dst")).alias("row")).distinct()
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.floor(F.col("row") / chunk)).alias("chunks"))
    return agg.withColumn("fill", F.round(F.col("rows") / (F.col("chunks") * chunk), 6)).withColumn("chunk_fraction", F.round(F.col("chunks") / -(-num_nodes // chunk), 6))


def distinct_jaccard(edges: DataFrame, key: str) -> DataFrame:
    """Exact distinct nodes of neighbouring groups and their Jaccard similarity: ``key, uniq, shared, jaccard`` with the next."""
    nodes = edges.select(key, F.explode(F.array("src", "dst")).alias("node")).distinct()
    uniq = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("uniq"))
    nxt = nodes.select((F.col(key) - 1).alias(key), "node")
    shared = nodes.join(nxt, [key, "node"]).groupBy(key).agg(F.count(F.lit(1)).alias("shared"))
    both = uniq.join(uniq.select((F.col(key) - 1).alias(key), F.col("uniq").alias("next")), key).join(shared, key, "left").na.fill(0, ["shared"])
    return both.select(key, "uniq", "shared", F.round(F.col("shared") / (F.col("uniq") + F.col("next") - F.col("shared")), 6).alias("jaccard"))


def sketch_distinct(edges: DataFrame, key: str) -> DataFrame:
    """Estimated distinct nodes by theta sketch."""
    nodes = edges.select(key, F.explode(F.array("src", "dst")).alias("node"))
    return nodes.groupBy(key).agg(F.expr("theta_sketch_estimate(theta_sketch_agg(node))").alias("estimate"))


def lane_barrier(rounds: DataFrame) -> DataFrame:
    """``rounds`` (round, lane, ms): barrier wait of each lane = slowest of the round - own."""
    return rounds.withColumn("wait", F.max("ms").over(Window.partitionBy("round")) - F.col("ms"))


def predicted_epoch(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("round").agg(F.max("ms").alias("ms")).agg(F.sum("ms").alias("epoch_ms"))


def summary(samples: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    agg = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.avg(value), 6).alias("avg"), F.max(value).alias("max"), F.round(F.stddev(value), 6).alias("std"))
    return agg.withColumn("spread", F.col("max") - F.col("min"))


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, p, nearest, interpolated``: the value at rank ceil(p n), and that between the two neighbours of place p (n - 1).

    Null values do not count; a group without values has null."""
    exact = [F.struct(F.lit(p).alias("p"), F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("double").alias("nearest"), F.percentile(value, F.lit(p)).alias("interpolated")) for p in points]
    sums = rows.groupBy(*by).agg(*[e.alias(f"__{i}") for i, e in enumerate(exact)])
    return sums.select(*by, F.explode(F.array(*[F.col(f"__{i}") for i in range(len(points))])).alias("__p")).select(*by, "__p.*")


def lane_moves(schedule: DataFrame) -> DataFrame:
    """``lane, superstep, part, move``: partitions that a lane admits or evicts when it goes from one state to the next.

    The first state admits all its partitions.
    """
    keys = ["lane", "superstep", "part"]
    now = schedule.select(*keys)
    before = schedule.select("lane", (F.col("superstep") + 1).alias("superstep"), "part")
    steps = schedule.select("lane", "superstep").distinct()
    admitted = now.join(before, keys, "left_anti").withColumn("move", F.lit("admit"))
    evicted = before.join(steps, ["lane", "superstep"], "left_semi").join(now, keys, "left_anti").withColumn("move", F.lit("evict"))
    return admitted.unionByName(evicted).select(*keys, "move")


def compatible_states(schedule: DataFrame) -> DataFrame:
    """``a, b``: pairs of states without a common partition.  A schedule has at most a few thousand states."""
    sets = schedule.groupBy("state").agg(F.collect_set("part").alias("parts"))
    x, y = sets.select(F.col("state").alias("a"), F.col("parts").alias("p")), sets.select(F.col("state").alias("b"), F.col("parts").alias("q"))
    return x.join(y, (F.col("a") < F.col("b")) & ~F.arrays_overlap("p", "q")).select("a", "b")


def overlap_stats(pairs: DataFrame) -> DataFrame:
    """By superstep, of the overlaps of its pairs of states: ``pairs, total, worst, mean, conflicts`` (pairs that overlap)."""
    return pairs.groupBy("superstep").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("overlap").alias("total"), F.max("overlap").alias("worst"),
        F.round(F.avg("overlap"), 6).alias("mean"), F.count_if(F.col("overlap") > 0).alias("conflicts"),
    )


def top_share_coverage(counts: DataFrame, share: float, key: str = "state") -> DataFrame:
    """Share of a state's accesses that the most accessed ``share`` of its entities take (at least one entity)."""
    sizes = counts.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("k"))
    rows = _by_access(counts, key).join(sizes, key)
    return rows.groupBy(key).agg(F.max("k").alias("entities"), F.round(F.sum(F.when(F.col("r") < F.col("k"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"))


def smallest_hashes(edges: DataFrame, key: str, k: int, seed: int = 21, salts: int = 16) -> DataFrame:
    """Distinct-count sketch of the nodes of a group: its ``k`` smallest distinct hashes as ``key, hash``.

    The smallest are taken inside ``salts`` slices of a group first, so at most ``salts`` x ``k`` rows of it meet in one task.
    """
    rows = edges.select(key, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("hash", h(seed, "node"))
    rows = rows.select(key, "hash", F.pmod(F.xxhash64("hash"), F.lit(salts)).alias("slice")).distinct()
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("r") <= k).drop("r")
    return first(first(rows, key, "slice").drop("slice"), key)


def merge_sketches(sketches: DataFrame, key: str, k: int) -> DataFrame:
    """The sketch of a union: the k smallest of all hashes; ``sketches`` may hold several of one key."""
    rows = sketches.select(key, "hash").distinct()
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).filter(F.col("r") <= k).drop("r")


def estimate_distinct(sketches: DataFrame, key: str, k: int) -> DataFrame:
    """``key, estimate``: (k - 1) / (k-th smallest hash as a share of the range); exact if there are fewer than k hashes."""
    agg = sketches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("kth"))
    return agg.select(key, F.when(F.col("n") < k, F.col("n").cast("double")).otherwise(F.round((k - 1) * (M * F.lit(1.0)) / F.col("kth"), 4)).alias("estimate"))


def sketch_overlap(sketches: DataFrame, key: str) -> DataFrame:
    """``key, similarity`` of a group and the next one: common hashes over the size of the smaller sketch."""
    size = sketches.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    after = lambda df: df.withColumn(key, F.col(key) - 1)
    shared = sketches.join(after(sketches), [key, "hash"]).groupBy(key).agg(F.count(F.lit(1)).alias("shared"))
    both = size.join(after(size).withColumnRenamed("n", "m"), key).join(shared, key, "left")
    return both.select(key, F.round(F.coalesce("shared", F.lit(0)) / F.least("n", "m"), 6).alias("similarity"))


def percent_change(samples: DataFrame, value: str, side: str, base, other, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of ``value`` where ``side`` is ``base`` or ``other``, and the change from one to the other in percent."""
    mean = lambda v: F.avg(F.when(F.col(side) == v, F.col(value)))
    agg = samples.groupBy(*by).agg(mean(base).alias("base"), mean(other).alias("other"))
    return agg.select(*by, F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round(100 * (F.col("other") - F.col("base")) / F.col("base"), 4).alias("change"))


def order_facts(schedule: DataFrame) -> DataFrame:
    """What the order of states does, a row a state: ``state, parts`` (ascending), ``kept`` (partitions that the state before it held too),
    ``new_pairs`` (pairs of partitions that meet for the first time) and ``clashes`` (its partitions in other states of the superstep).

    ``schedule``: state, part, lane, superstep."""
    s = schedule.select("state", "part", "superstep")
    parts = s.groupBy("state").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    kept = s.join(s.select((F.col("state") + 1).alias("state"), "part"), ["state", "part"]).groupBy("state").agg(F.count(F.lit(1)).alias("kept"))
    met = s.select("state", F.col("part").alias("a")).join(s.select("state", F.col("part").alias("b")), "state").filter("a < b")
    new = met.groupBy("a", "b").agg(F.min("state").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("new_pairs"))
    other = s.select(F.col("state").alias("other"), "part", "superstep")
    clashes = s.join(other, ["superstep", "part"]).filter("state <> other").groupBy("state").agg(F.count(F.lit(1)).alias("clashes"))
    out = parts.join(kept, "state", "left").join(new, "state", "left").join(clashes, "state", "left")
    return out.na.fill(0, ["kept", "new_pairs", "clashes"])


def assign_nodes(nodes: DataFrame, states: DataFrame, part: str = "part", seed: int = 31) -> DataFrame:
    """``nodes`` (node_id and the partition of each) with ``state``: one of the states that hold the partition, by hash (the only one in an
    ordering whose states are disjoint).  States are few, so their table is broadcast."""
    held = states.groupBy(F.col("part").alias("__part")).agg(F.array_sort(F.collect_set("state")).alias("__states"))
    rows = nodes.join(F.broadcast(held), F.col(part) == F.col("__part"))
    return rows.withColumn("state", F.get("__states", (h(seed, "node_id") % F.size("__states")).cast("int"))).drop("__part", "__states")
