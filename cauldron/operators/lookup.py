"""Serving queries: paging, point lookup, top-k, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filtered(df: DataFrame, segment: str | None, search: str | None, key: str,
              segment_col: str) -> DataFrame:
    out = df
    if segment:
        out = out.where(F.col(segment_col) == segment)
    if search:
        # literal substring of the id rendered as text (no LIKE wildcards)
        out = out.where(F.instr(F.col(key).cast("string"), search) > 0)
    return out


def list_customers(df: DataFrame, offset: int = 0, limit: int = 25, segment: str | None = None,
                   search: str | None = None, key: str = "customer_id",
                   segment_col: str = "customer_segment", after: int | None = None) -> DataFrame:
    """One page ordered by id plus the filtered total as a column.

    ``orderBy().offset().limit()`` plans as a bounded top-k
    (TakeOrderedAndProject over offset + limit rows), not a full sort. Deep
    pages go by ``after``, the last id of the page before: that filter reaches
    the scan, and one page is all that is kept.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    f = _filtered(df, segment, search, key, segment_col)
    total = f.select(F.count(F.lit(1))).scalar()
    page = f if after is None else f.where(F.col(key) > F.lit(after))
    return page.orderBy(key).offset(offset).limit(limit).withColumn("total", total)


def get_customer(df: DataFrame, customer_id: int, key: str = "customer_id") -> DataFrame:
    """Point lookup; the predicate reaches the parquet scan."""
    return df.where(F.col(key) == F.lit(customer_id)).limit(1)


def top_ite(df: DataFrame, limit: int = 10, score_col: str = "ite", key: str = "customer_id") -> DataFrame:
    """Highest predicted effects first, ties by id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    return df.orderBy(F.col(score_col).desc(), F.col(key).asc()).limit(limit)


def drop_ground_truth(df: DataFrame, cols=("true_ite",)) -> DataFrame:
    """Remove ground truth before any scoring decision."""
    return df.drop(*[c for c in cols if c in df.columns])


def search_recommendations(selected: DataFrame, search: str | None = None, segment: str | None = None,
                           limit: int = 25, key: str = "customer_id") -> DataFrame:
    """Selected list filtered by id substring and uplift segment, first n by profit (P5)."""
    f = _filtered(selected, segment, search, key, "uplift_segment")
    return f.orderBy(F.col("expected_profit").desc(), F.col(key).asc()).limit(limit)
