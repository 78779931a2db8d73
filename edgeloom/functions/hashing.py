"""A hash in plain integer arithmetic, so that every random choice can be repeated in any SQL engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647  # 2**31 - 1, a prime


def _col(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)).cast("bigint")


def _low_high(x) -> tuple[Column, Column]:
    """The remainder modulo M and what is above it (also modulo M), so that ids beyond M count whole."""
    x, m = _col(x), F.lit(M).cast("bigint")
    low = F.pmod(x, m)
    return low, F.pmod(F.call_function("div", x - low, m), m)


def h(seed: int, a, b=0) -> Column:
    """Hash of (a, b) to 0 .. M - 1; x -> x**5 is a bijection modulo M.  Columns, names or integers; null gives null."""
    m = F.lit(M).cast("bigint")
    (al, ah), (bl, bh) = _low_high(a), _low_high(b)
    x = F.pmod(al * 1103515245 + ah * 1000003 + bl * 12345 + bh * 69069 + F.lit(seed * 48271 + 1).cast("bigint"), m)
    x2 = x * x % m
    return x2 * x2 % m * x % m


def draw(seed: int, a, b, n) -> Column:
    """A number below ``n`` (up to 2**62) from the hash of (a, b)."""
    return (h(seed, a, b) * M + h(seed + 7919, a, b)) % n


def h_numpy(seed: int, a, b=0) -> np.ndarray:
    """``h`` of integers or integer arrays."""
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    x = (a % M * 1103515245 + a // M % M * 1000003 + b % M * 12345 + b // M % M * 69069 + seed * 48271 + 1) % M
    x2 = x * x % M
    return x2 * x2 % M * x % M


def h_sql(seed: int, a: str, b: str = "0") -> str:
    low = lambda v: f"((({v})::BIGINT % {M} + {M}) % {M})"
    high = lambda v: f"(((({v})::BIGINT - {low(v)}) // {M} % {M} + {M}) % {M})"
    part = lambda v, p, q: str(int(v) * p) if v.isdigit() else f"{low(v)} * {p} + {high(v)} * {q}"
    x = f"({part(a, 1103515245, 1000003)} + {part(b, 12345, 69069)} + {seed * 48271 + 1}) % {M}"
    x2 = f"(({x}) * ({x}) % {M})"
    return f"({x2} * {x2} % {M} * ({x}) % {M})"


def draw_sql(seed: int, a: str, b: str, n: str) -> str:
    return f"(({h_sql(seed, a, b)} * {M} + {h_sql(seed + 7919, a, b)}) % ({n}))"
