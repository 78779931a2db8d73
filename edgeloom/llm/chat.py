"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Loggers often store a conversation again after every turn.  Every turn gets the hash of all turns up to it (a running
exclusive-or of two 64-bit hashes that contain the position, so it can be summed in parts); a conversation whose last hash
is the hash of a longer conversation's prefix is a snapshot and goes, by an anti-join on (length, hash).  Of equal
conversations that with the smallest id stays.  What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import checked_broadcast, materialise, maybe_among

#: Turn numbers that are ordered and hashed together; longer conversations are handled in several runs.
RUN = 256
#: Turns in a rendered row; longer conversations have several rows (part 0, 1, ...).
PART = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: A conversation (null is one of its own), and a run of it.
CONV = ["lost", "cid"]
KEY = [*CONV, "run", "sub"]
TURN = [*KEY, "turn", "role"]


def _piece() -> Column:
    return F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    """``TURN`` columns, ``text`` and its two hashes ``a, b``.  Turns without a number come first and are cut into runs by the
    beginning of their order (role, text), so that none of them is large for lack of numbers."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    run = F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 60))).cast("bigint").alias("run")
    sub = F.when(F.col("turn").isNull(), F.concat("role", F.lit("\0"), F.substring("text", 1, 2))).otherwise(F.lit("")).alias("sub")
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(n) for k, n in ((1, "a"), (2, "b"))]
    return rows.select(F.col("conv_id").isNull().alias("lost"), F.coalesce("conv_id", F.lit(0)).alias("cid"), run, sub, F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", *hashes)


def _in_order(turns: DataFrame) -> DataFrame:
    """``TURN`` columns, ``a, b`` and ``k``, the place in the run (from 1), of every different turn.

    The rows that are moved have hashes in place of texts.  Texts are compared only where turns of a conversation agree in
    number and role: those get their order ``t`` from a scan of their own."""
    slim = turns.select(*TURN, "a", "b").repartition(*KEY).groupBy(*TURN, "a", "b").agg(F.lit(0).alias("t"))
    ties = materialise(slim.groupBy(*TURN).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if not ties.isEmpty():
        some = maybe_among(turns, [F.col(c) for c in TURN], ties).join(ties, TURN, "left_semi").select(*TURN, "a", "b", "text").distinct()
        order = some.withColumn("t2", F.row_number().over(Window.partitionBy(*TURN).orderBy("text"))).drop("text")
        slim = slim.join(checked_broadcast(materialise(order)), [*TURN, "a", "b"], "left").withColumn("t", F.coalesce("t2", "t")).drop("t2")
    return slim.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("turn", "role", "t")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``TURN`` columns, ``a, b``, ``pos`` (from 1), ``n_turns``, ``n_runs`` and ``h1, h2``: the hash of turns 1 .. pos.

    One exchange brings the turns of a run together; the numbers and hashes of runs, few rows each, are summed by conversation
    and joined back to rows that lie where they are."""
    rows = _in_order(turns)
    whole, before = Window.partitionBy(*CONV), Window.partitionBy(*CONV).orderBy("run", "sub").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*KEY).agg(F.max("k").alias("n"))
    runs = runs.select(*KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"), F.count(F.lit(1)).over(whole).alias("n_runs"))
    rows = rows.join(runs, KEY).withColumn("pos", F.col("k") + F.col("skip"))
    rows = rows.withColumn("x", F.xxhash64("pos", "a")).withColumn("y", F.xxhash64("pos", "b"))
    sums = rows.groupBy(*KEY).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select(*KEY, *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("x", "y")])
    own = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, KEY)
    return rows.select(*TURN, "a", "b", "pos", "n_turns", "n_runs", *[F.bit_xor(c).over(own).bitwiseXOR(F.col(f"{c}0")).alias(h) for c, h in (("x", "h1"), ("y", "h2"))])


def maximal(hashed: DataFrame) -> DataFrame:
    """``CONV`` columns and ``copies`` of the conversations that no other one has as a proper prefix, one of equal ones."""
    whole = hashed.filter("pos = n_turns").groupBy("n_turns", "h1", "h2").agg(F.min(F.struct(*CONV)).alias("c"), F.count(F.lit(1)).alias("copies"))
    prefixes = hashed.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("c.*", "copies")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per retained conversation and ``PART`` turns: ``conv_id, n_turns, copies, part, rendered``.

    Turns are ordered by (turn, role, text), null first; exactly repeated turns count once; null role is ``unknown``, null
    text empty; turns may be as long or as many as they like.  A null conv_id is one conversation of its own.  ``copies``
    counts equal conversations (itself included), of which that with the smallest id stays.  An empty table gives an empty
    result; columns other than conv_id, turn, role and text are not read.

    Texts move once, and only those of retained conversations: they join their places, and a conversation of one run is
    rendered where it lies.
    """
    turns = _turns(conversations)
    hashed = materialise(prefix_hashes(turns))
    kept = materialise(maximal(hashed))
    facts = ["pos", "n_turns", "n_runs", "copies"]
    places = hashed.join(kept, CONV).select(*TURN, "a", "b", F.lit(None).cast("string").alias("text"), *facts)
    texts = maybe_among(turns, [F.col(c) for c in CONV], kept.select(*CONV))
    texts = texts.select(*TURN, "a", "b", "text", *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in facts])
    # a join by one exchange: a turn's text and its place meet in a group; repeated turns are one
    rows = texts.unionByName(places).repartition(*KEY).groupBy(*TURN, "a", "b").agg(*[F.max(c).alias(c) for c in ("text", *facts)]).filter("pos IS NOT NULL")
    piece = F.struct("pos", _piece().alias("piece"))
    turned = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda t: t["piece"]), "").alias("rendered")
    own = [F.max(c).alias(c) for c in ("n_turns", "copies")]
    part = F.expr(f"int((pos - 1) div {PART})")
    alone = rows.filter("n_runs = 1").withColumn("part", part).groupBy(*KEY, "part").agg(*own, turned).drop("run", "sub")
    long = rows.filter("n_runs > 1").withColumn("part", part).groupBy(*CONV, "part").agg(*own, turned)
    out = alone.unionByName(long)
    return out.select(F.when(~F.col("lost"), F.col("cid")).alias("conv_id"), "n_turns", "copies", "part", "rendered")


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS piece FROM t
), p AS (
  SELECT conv_id, pos, string_agg(piece, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r
), w AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, prefix FROM p WHERE pos = n_turns GROUP BY n_turns, prefix
), k AS (
  SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.prefix = w.prefix)
)
SELECT k.conv_id, k.n_turns, k.copies, ((r.pos - 1) // {PART})::INT AS part, string_agg(r.piece, '' ORDER BY r.pos) AS rendered
FROM k JOIN r ON k.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY ALL
"""
