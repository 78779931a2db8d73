"""Assertions about values, as counts of offending rows in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(column: str) -> Column:
    return F.col(column).isNull()


def not_nan(column: str) -> Column:
    return F.isnan(column)


def not_negative(column: str) -> Column:
    return F.col(column) < 0


def in_range(column: str, low, high) -> Column:
    """Half open: low <= value < high."""
    return (F.col(column) < low) | (F.col(column) >= high)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, bad``: rows that break each rule.  One pass over the table, whatever the number of rules."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("bad")) for n in rules])).alias("r")).select("r.*")


def require(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows``; raises ValueError with the rules that are broken."""
    broken = {r["rule"]: r["bad"] for r in violations(rows, rules).filter("bad > 0").collect()}
    if broken:
        raise ValueError(f"broken rules (rows): {broken}")
    return rows
