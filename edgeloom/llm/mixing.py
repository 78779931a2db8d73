"""Temperature mixing of sources (DataFrame functions only).

Token shares are raised to an exponent between 0 and 1, which bisection sets so that the weights meet a target entropy; if
the most repeated source would then be passed more often than the limit, the exponent is bisected up to that limit.  The
weights are realised without cutting any source below one whole pass: the budget is the smallest that gives every source a
full pass, further passes and a last partial one come on top.  Every pass is a permutation of the source's blocks, and the
partial one takes whole blocks of its permutation while they fit the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.llm.common import checked_broadcast, materialise

BLOCKS = 1024
#: Share of the greatest possible entropy that the weights should have.
ENTROPY = 0.97
#: Most passes over any source.
REPEATS = 2.0
SEED = 17
#: Bisection steps in one aggregation, and aggregations: 8 x 6 halvings.
STEPS, ROUNDS = 6, 8

_M = 2147483647


def spread(a: Column, b: Column, seed: int) -> Column:
    """Hash of two integers to 0 .. 2**31 - 2 in plain arithmetic, so that other SQL engines agree."""
    a, b, m = a.cast("bigint"), b.cast("bigint"), F.lit(_M).cast("bigint")
    x = F.pmod(F.pmod(a, m) * 1103515245 + F.pmod(b, m) * 12345 + seed * 48271 + 1, m)
    x2 = x * x % _M
    x4 = x2 * x2 % _M
    return x4 * x % _M


def tokens() -> Column:
    """Words of the whole text."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def block_of() -> Column:
    return (spread(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.lit(0), SEED) % BLOCKS).cast("int")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """Exponent in 0 .. 1 for ``sources`` (source, tokens > 0).  Only a few sums an aggregation come to the driver."""

    def bisect(ok) -> float:
        """The largest (if ok holds at 0) exponent with ok, by halving; ok gets the aggregates of an exponent."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            n = 1 << STEPS
            grid = [low + (high - low) * i / n for i in range(n + 1)]
            rows = (
                sources.select("tokens", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("i", "g"))
                .withColumn("u", F.pow(F.col("tokens").cast("double"), F.col("g")))
                .groupBy("i")
                .agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulogu"), F.max(F.col("u") / F.col("tokens")).alias("top"), F.min(F.col("u") / F.col("tokens")).alias("low"))
                .collect()
            )
            at = {r["i"]: r for r in rows}
            a, b = 0, n
            while b - a > 1:  # six halvings on the grid
                mid = (a + b) // 2
                a, b = (mid, b) if ok(at[mid]) else (a, mid)
            low, high = grid[a], grid[b]
        return low

    n = sources.count()
    if n < 2:
        return 1.0
    import math

    target = entropy * math.log(n)
    by_entropy = bisect(lambda r: math.log(r["z"]) - r["ulogu"] / r["z"] >= target)
    # passes of a source are proportional to u / tokens; those of the least repeated one are one
    by_repeats = bisect(lambda r: r["top"] / r["low"] > repeats)
    return max(by_entropy, by_repeats)


def plan(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``source, block, pass, place``: the passes of every block and its place in the pass, from 0 to 1.

    ``budget`` is the number of tokens to draw in all, dealt to the sources by their weights; a source that gets less than
    its size gives whole blocks of its permutation while they fit.  Without one it is the smallest that gives every source a
    whole pass.  At most sources x ``BLOCKS`` x passes rows.
    """
    blocks = materialise(docs.select("source", block_of().alias("block"), tokens().alias("t")).groupBy("source", "block").agg(F.sum("t").alias("t")))
    sums = materialise(blocks.groupBy("source").agg(F.sum("t").alias("tokens")))
    some = sums.filter("tokens > 0")
    e = exponent(some, entropy, repeats)
    u = F.pow(F.col("tokens").cast("double"), F.lit(e)) / F.col("tokens")
    least, weight = some.agg(F.min(u), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(e)))).first()
    per_token = u / F.lit(least or 1.0) if budget is None else u * F.lit(budget / (weight or 1.0))
    take = F.when(F.col("tokens") > 0, F.floor(per_token * F.col("tokens") + 0.5)).otherwise(0).cast("bigint")
    sums = sums.select("source", "tokens", take.alias("take"))
    passes = F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(1)
    sums = sums.select("source", passes.alias("passes"), F.when(F.col("tokens") > 0, F.col("take") % F.col("tokens")).otherwise(0).alias("rest"))
    rows = blocks.alias("b").join(sums.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "passes", "rest")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
    own = Window.partitionBy("source", "pass").orderBy(spread(F.col("block"), F.col("pass"), SEED + 1), "block")
    fits = (F.col("pass") < F.col("passes")) | (F.sum("t").over(own) <= F.col("rest"))
    place = (F.row_number().over(own) - 1) / F.lit(BLOCKS)
    return rows.withColumn("fits", fits).withColumn("place", place).filter("fits").select("source", "block", "pass", "place")


def draws(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) of every drawn row, with ``block``, ``pass`` and ``place``.  The plan is
    broadcast if it is small, else shuffled by (source, block), which spreads a hot source over ``BLOCKS`` keys."""
    p = checked_broadcast(materialise(plan(docs.select("doc_id", "text", "source"), entropy, repeats, budget)))
    left = docs.select(F.struct("*").alias("row"), F.col("source").alias("own"), block_of().alias("in_block"))
    return left.join(p, F.col("own").eqNullSafe(F.col("source")) & (F.col("in_block") == F.col("block"))).select("row", "block", "pass", "place")


def mixture(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """One row per draw: ``doc_id, source, tokens, block, pass, place``.  Sorted by (pass, place) it is a mixed stream.

    Without a ``budget`` every document is drawn at least once: no source is cut below a full pass.  Null is a source of its own; sources without
    any word get one pass.  Null texts count no tokens.  Repeated rows are drawn alike.  One source or an empty table: each row
    once.  Columns other than doc_id, text and source are not read.
    """
    drawn = draws(docs.select("doc_id", "text", "source"), entropy, repeats, budget)
    return drawn.select("row.*", "block", "pass", "place").select("doc_id", "source", tokens().alias("tokens"), "block", "pass", F.round("place", 6).alias("place"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """The drawn rows with the columns of ``docs``, whatever their names: without a budget every row at least once, null and empty texts
    too; rows without ``doc_id`` are one block of their source; repeated rows are drawn alike; an empty table gives an empty result."""
    return draws(docs, entropy, repeats, budget).select("row.*")


def _sql_spread(a: str, b: str, seed: int) -> str:
    x = f"(((({a})::BIGINT % {_M} + {_M}) % {_M}) * 1103515245 + (({b})::BIGINT % {_M}) * 12345 + {seed * 48271 + 1}) % {_M}"
    x2 = f"(({x}) * ({x}) % {_M})"
    return f"({x2} * {x2} % {_M} * ({x}) % {_M})"


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         ({_sql_spread("coalesce(doc_id, -1)", "0", SEED)} % {BLOCKS})::INT AS block
  FROM documents
), blocks AS (SELECT source, block, sum(tokens)::BIGINT AS t FROM d GROUP BY ALL),
sums AS (SELECT source, sum(t)::BIGINT AS tokens FROM blocks GROUP BY ALL),
positive AS (SELECT list(tokens::DOUBLE) AS ts, count(*) AS n FROM sums WHERE tokens > 0),
ent AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid,
           ln(list_sum([pow(x, (low + high) / 2) for x in ts]))
           - list_sum([pow(x, (low + high) / 2) * ln(pow(x, (low + high) / 2)) for x in ts]) / list_sum([pow(x, (low + high) / 2) for x in ts])
           >= {ENTROPY} * ln(n) AS ok
    FROM ent, positive WHERE i < {STEPS * ROUNDS})
), rep AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid,
           list_max([pow(x, (low + high) / 2) / x for x in ts]) / list_min([pow(x, (low + high) / 2) / x for x in ts]) > {REPEATS} AS ok
    FROM rep, positive WHERE i < {STEPS * ROUNDS})
), e AS (
  SELECT CASE WHEN (SELECT n FROM positive) < 2 THEN 1.0 ELSE greatest((SELECT max(low) FROM ent WHERE i = {STEPS * ROUNDS}), (SELECT max(low) FROM rep WHERE i = {STEPS * ROUNDS})) END AS e
), u AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, e) / tokens END AS u FROM sums, e),
taken AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(u / (SELECT min(u) FROM u) * tokens + 0.5)::BIGINT ELSE 0 END AS take FROM u
), p AS (
  SELECT source, CASE WHEN tokens > 0 THEN take // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN take % tokens ELSE 0 END AS rest FROM taken
), b AS (
  SELECT b.source, b.block, b.t, passes, rest, unnest(range(0, passes + 1)) AS pass
  FROM blocks b JOIN p ON b.source IS NOT DISTINCT FROM p.source
), w AS (
  SELECT *, sum(t) OVER o AS so_far, (row_number() OVER o - 1) / {BLOCKS}.0 AS place FROM b
  WINDOW o AS (PARTITION BY source, pass ORDER BY {_sql_spread("block", "pass", SEED + 1)}, block ROWS UNBOUNDED PRECEDING)
)
SELECT d.doc_id, d.source, d.tokens, d.block, w.pass::INT AS pass, round(w.place::DOUBLE, 6) AS place
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.block = w.block
WHERE w.pass < w.passes OR w.so_far <= w.rest
"""
