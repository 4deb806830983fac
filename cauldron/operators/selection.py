"""Weighted selection: the row at which a running sum passes a target, without ranking the rows.

A cut is the first row in (value, ties) order whose running weight, itself
included, is above the target. Rows before it are known by comparing their
key with the cut's, so a budget needs one filter, not a global order.

The narrow keyed table is written once. Cells of the order are refined: the
quantiles of a cell's values part it into up to ``CELLS`` smaller ones, whose
weights and rows are one small aggregation; the cell in which a target falls
is refined in turn, by the last tie (a unique number) where all its values
are equal. A cell of at most ``CELL_ROWS`` rows is ordered, and nothing else
is. Rounds grow with the logarithm of the rows; no row is shuffled before the
last step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import run_concurrently, write_stage_table

CELLS = 256
CELL_ROWS = 65_536
_INF = float("inf")


@dataclass(frozen=True)
class Cut:
    """A cut's key, the weight of all rows before it, and its own weight."""

    key: tuple
    before: object
    weight: object


@dataclass
class _Cell:
    rows: DataFrame
    count: int
    before: object
    targets: list
    axis: int  # column of the key to refine by; None when nothing is left to part it


def ascending(value: Column) -> Column:
    """A double key with missing values (NULL, NaN) last."""
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(_INF)).otherwise(value)


def precedes(keys: list[Column], cut: Cut | None, schema: list) -> Column:
    """Whether a row's key is before the cut; true without a cut."""
    if cut is None:
        return F.lit(True)
    out = F.lit(False)
    for key, at, kind in reversed(list(zip(keys, cut.key, schema))):
        at = F.lit(at).cast(kind)
        out = (key < at) | ((key == at) & out)
    return out


def is_cut(keys: list[Column], cut: Cut | None, schema: list) -> Column:
    if cut is None:
        return F.lit(False)
    out = F.lit(True)
    for key, at, kind in zip(keys, cut.key, schema):
        out = out & (key == F.lit(at).cast(kind))
    return out


def _refine(cell: _Cell, width: int) -> list[_Cell]:
    """The parts of a cell in which its targets fall."""
    axis = f"k{cell.axis}"
    points = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    value = F.col(axis).cast("double")
    found = cell.rows.agg(F.percentile_approx(value, points, 40 * CELLS).alias("q"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    if found.low == found.high:  # ties: go on by the unique number
        return [_Cell(cell.rows, cell.count, cell.before, cell.targets, width - 1 if cell.axis == 0 and width == 2 else None)]
    splits = [-_INF, *sorted({x for x in [*found.q, found.high] if found.low < x < _INF}), _INF]
    if len(splits) < 3:
        return [_Cell(cell.rows, cell.count, cell.before, cell.targets, None)]
    cut = Bucketizer(splits=splits, inputCol="_axis", outputCol="_cell").transform(cell.rows.withColumn("_axis", value))
    parts = cut.groupBy("_cell").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min(axis).alias("low"), F.max(axis).alias("high"))
    out, run = [], cell.before
    for p in parts.orderBy("_cell").collect():  # at most CELLS + 1 rows
        mine = [t for t in cell.targets if run <= t[1] < run + p.w]
        if mine:
            inside = (F.col(axis) >= F.lit(p.low)) & (F.col(axis) <= F.lit(p.high))
            out.append(_Cell(cell.rows.where(inside), p.n, run, mine, cell.axis))
        run += p.w
    return out


def _order(cell: _Cell, width: int) -> dict:
    """target number -> Cut, from the ordered rows of one small cell."""
    keys = [f"k{i}" for i in range(width)]
    run = F.sum("w").over(Window.partitionBy("one").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = cell.rows.select(*keys, "w", F.lit(1).alias("one")).select(*keys, "w", run.alias("run"))
    firsts = [F.min(F.when(F.lit(cell.before) + F.col("run") > F.lit(t), F.struct(*keys, "run", "w"))).alias(f"t{n}") for n, t in cell.targets]
    row = rows.agg(*firsts).first()
    return {n: Cut(tuple(row[f"t{n}"][:width]), cell.before + row[f"t{n}"].run - row[f"t{n}"].w, row[f"t{n}"].w) for n, _ in cell.targets}


def weighted_cuts(df: DataFrame, keys: list[Column], weight: Column, targets, cell_rows: int = CELL_ROWS) -> tuple[list, list]:
    """(the Cut of each target, None where all rows together stay within it; the key's types).

    ``keys`` ascend: a double first (see ``ascending``), the ties after it,
    the last one a unique number; ``weight`` is a positive exact number.
    ``targets`` are numbers, or a function of (rows, total weight) that gives them.
    """
    narrow = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], weight.alias("w"))
    kinds = [f.dataType for f in narrow.schema.fields[:len(keys)]]
    narrow = write_stage_table(narrow, "selection")
    whole = narrow.agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    targets = list(targets(whole.n, whole.w) if callable(targets) else targets)
    cuts: dict = {}
    zero = (whole.w or 0) * 0
    inside = [(i, t) for i, t in enumerate(targets) if whole.n and t < whole.w]
    # below zero the very first row is over the target: it is found as for zero
    cells = [_Cell(narrow, whole.n, zero, [(i, max(t, zero)) for i, t in inside], 0)] if inside else []
    while cells:
        small = [c for c in cells if c.count <= cell_rows or c.axis is None]
        for found in run_concurrently([lambda c=c: _order(c, len(keys)) for c in small]):
            cuts |= found
        big = [c for c in cells if not (c.count <= cell_rows or c.axis is None)]
        cells = [part for parts in run_concurrently([lambda c=c: _refine(c, len(keys)) for c in big]) for part in parts]
    return [cuts.get(i) for i in range(len(targets))], kinds
