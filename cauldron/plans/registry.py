"""Registry of queries (Spark) and their oracle SQL (DuckDB).

Every query reads the driver's tables through the derivation in
``sources.derived`` so its work grows with them.  Oracle SQL follows the
agreement rules: ids break every tie, running money in integer cents, ROI
rounded to 9 dp before sorting, float aggregates rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import derived

QUERIES: dict = {}
ORACLE_SQL: dict = {}

FLAGSHIP_BUDGET = 10000.0
SMALL_BUDGET = 5000.0


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


def W(*names: str, extra: str = "") -> str:
    return derived.with_derived(*names, extra=extra)


def load_all() -> None:
    """Import every catalog so its queries register themselves."""
    from . import (  # noqa: F401
        catalog_allocation, catalog_extra, catalog_io, catalog_models, catalog_quality, catalog_views,
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations for a budget: derive -> segment -> greedy -> top rows."""
    from ..operators import allocate as al

    return al.recommendations(derived.scored(spark, sf_dir), FLAGSHIP_BUDGET, limit=25)


def rounded(df: DataFrame, digits: int = 6, cols=None, skip=()) -> DataFrame:
    """Round double columns (float aggregates differ in the last bits between engines)."""
    targets = set(cols) if cols is not None else {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(F.col(n), digits).alias(n) if n in targets and n not in skip else F.col(n)
                       for n in df.columns])


def stable_scored(spark: SparkSession, d: str) -> DataFrame:
    """The derived table computed once and written to the shared folder.

    Queries that read it several times (the prefix kernel samples before its
    final pass; joins of customers, predictions and recommendations) then scan
    the columns they need instead of re-aggregating all orders and events.
    """
    from ..session import write_stage_table

    return write_stage_table(derived.scored(spark, d), "scored")


def stable_customers(spark: SparkSession, d: str, scored: DataFrame | None = None) -> DataFrame:
    from ..schema import CUSTOMER_SCHEMA

    s = scored if scored is not None else stable_scored(spark, d)
    return s.select(*[f.name for f in CUSTOMER_SCHEMA.fields])
