"""Scalar column functions used across operators.

Everything is built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def is_finite(x) -> Column:
    c = _c(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def cents(x) -> Column:
    """Money as integer cents: exact sums, identical in every engine."""
    return F.round(_c(x) * F.lit(100.0)).cast("bigint")


def label(x) -> Column:
    """A stored name as a label: its first letter upper case, the rest as it is (``initcap`` would change every word)."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.substr(_c(x), F.lit(2)))


MONEY = "decimal(38, 9)"


def money(x) -> Column:
    """Money as an exact decimal with nine fractional digits: sums don't depend on partitioning or rounding."""
    return _c(x).cast(MONEY)


def hash_uniform(key, seed: int, salt: str = "u") -> Column:
    """Uniform in (0, 1) from 52 bits of the MD5 of 'salt:seed:key': reproducible
    under recomputation and repartitioning, unlike ``rand()``, and in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(int(seed))), _c(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def hash_normal(key, seed: int) -> Column:
    """Standard normal via Box-Muller on two hash uniforms."""
    u1 = hash_uniform(key, seed, "n1")
    u2 = hash_uniform(key, seed, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
