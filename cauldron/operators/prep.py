"""Feature preparation.

A fitted ``Preprocessor`` holds only bounded state (one mean and one
population std per numeric column, the sorted category list) learned in one
aggregate; transforming is pure column arithmetic.  Randomness always comes
from hashes of the key, so results do not move under recomputation or
repartitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_normal, hash_uniform
from ..schema import HETEROGENEITY_NUMERIC, FeatureConfig
from ..session import write_stage_table
from .ordered import default_partitions, global_rank


@dataclass
class PreprocessorModel:
    numeric: list
    categorical: list
    means: dict
    stds: dict
    categories: dict
    warnings: list = field(default_factory=list)

    @property
    def dummy_names(self) -> list:
        return [f"{c}_{v}" for c in self.categorical for v in self.categories[c]]

    @property
    def feature_names(self) -> list:
        """Fixed order: numeric columns, then every dummy."""
        return list(self.numeric) + self.dummy_names

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled numeric columns and 0/1 dummies; unseen categories -> all zeros."""
        cols = []
        for c in self.numeric:
            sd = self.stds[c]
            z = (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(sd) if sd > 0 else F.lit(0.0)
            cols.append(z.alias(f"f_{c}"))
        for c in self.categorical:
            for v in self.categories[c]:
                cols.append(F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"f_{c}_{v}"))
        keep = [F.col(c) for c in df.columns]
        return df.select(*keep, *cols)

    def columns(self, names) -> list:
        return [f"f_{n}" for n in names]


class Preprocessor:
    """z-score with population std (zero variance -> 0) + full one-hot."""

    def __init__(self, config: FeatureConfig = FeatureConfig(), extra_numeric=()):
        self.config = config
        self.numeric = list(config.numeric) + [c for c in extra_numeric if c not in config.numeric]
        self.categorical = list(config.categorical)

    def fit(self, df: DataFrame) -> PreprocessorModel:
        aggs = []
        for i, c in enumerate(self.numeric):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggs).collect()[0] if aggs else {}
        means = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(self.numeric)}
        stds = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(self.numeric)}
        cats = {}
        for c in self.categorical:
            # the levels are the model's own state: one dummy each
            cats[c] = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
        return PreprocessorModel(self.numeric, self.categorical, means, stds, cats)


def standardize(df: DataFrame, cols) -> DataFrame:
    """F1 alone: population z-scores of ``cols`` (zero variance -> 0)."""
    m = Preprocessor(FeatureConfig(covariates=tuple(cols), confounders=())).fit(df)
    return m.transform(df)


def one_hot(df: DataFrame, col: str) -> DataFrame:
    """F2 alone: dummies ``f_<col>_<value>`` over the sorted learned values."""
    m = Preprocessor(FeatureConfig(covariates=(), confounders=(col,))).fit(df)
    return m.transform(df)


class SparseOneHot:
    """One-hot vectors of a column with any number of levels (F2).

    The sorted levels and their places are a written table, joined by value;
    vectors are sparse, so neither the plan nor the driver holds a level. A
    value that was not seen, or is NULL, gives the zero vector.
    """

    SHARED_LEVELS = 100_000

    def __init__(self, col: str, levels: DataFrame, size: int, encoder):
        self.col, self.levels, self.size, self.encoder = col, levels, size, encoder

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "SparseOneHot":
        found = df.select(F.col(col).cast("string").alias("_level")).where(F.col("_level").isNotNull()).distinct()
        found = write_stage_table(found, "distinct-levels")
        ranked = global_rank(found.withColumn("_tie", F.xxhash64("_level")), "_level", "_tie", desc=False, rank="_rank")
        levels = write_stage_table(ranked.select("_level", (F.col("_rank") - 1).cast("double").alias("_place")), "levels")
        size = levels.count()
        # the extra place for values not seen is the last one, which is dropped
        encoder = OneHotEncoder(inputCols=["_place"], outputCols=["_vector"], handleInvalid="keep", dropLast=True).fit(levels) if size else None
        return cls(col, levels, size, encoder)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        if not self.size:
            return df.withColumn(out, F.lit(None).cast(VectorUDT()))
        levels = F.broadcast(self.levels) if self.size <= self.SHARED_LEVELS else self.levels
        joined = df.join(levels, F.col(self.col).cast("string") == F.col("_level"), "left")
        coded = self.encoder.transform(joined.withColumn("_place", F.coalesce("_place", F.lit(float(self.size)))))
        return coded.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_vector").alias(out))


def heterogeneity_columns(model: PreprocessorModel) -> list:
    """Effect-model inputs: the fixed numeric list plus every segment dummy."""
    names = [c for c in model.numeric if c in HETEROGENEITY_NUMERIC]
    names += [d for d in model.dummy_names if d.startswith("customer_segment")]
    return names


def assemble(df: DataFrame, names, out: str) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol=out, handleInvalid="error").transform(df)


def train_test_split(df: DataFrame, key: str = "customer_id", seed: int = 42, train_fraction: float = 0.8,
                     out: str = "split") -> DataFrame:
    """Hash split, stable under repartitioning."""
    u = hash_uniform(key, seed, "split")
    return df.withColumn(out, F.when(u < F.lit(train_fraction), "train").otherwise("test"))


def add_noise_feature(df: DataFrame, key: str = "customer_id", seed: int = 42, out: str = "random_noise") -> DataFrame:
    """Standard normal column from hashes of the key."""
    return df.withColumn(out, hash_normal(key, seed))


def _hash_ranked(df: DataFrame, key: str, seed: int, salt: str, tie: str, rank: str) -> DataFrame:
    """1-based place of each row in the order of a hash of its key.

    Ranges of the hash are dealt to tasks, evenly as the hash is uniform; a
    range's rows follow those of the ranges before it, counted in a table of
    one row a range.
    """
    ranges = 4 * default_partitions(df)
    place = hash_uniform(key, seed, salt)
    rows = df.withColumns({"_u": place, "_range": F.floor(place * ranges).cast("int")})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("_u", key, tie)
    placed = rows.withColumn("_n", F.row_number().over(within)).join(F.broadcast(before), "_range")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_n")).alias(rank))


def permute_treatment(df: DataFrame, treatment_col: str = "treatment_received", key: str = "customer_id",
                      seed: int = 42, out: str | None = None, circle: bool = True) -> DataFrame:
    """Shuffle the treatment over rows, keeping its counts exactly (F8); into column ``out``, by default in place.

    Without ``circle`` any permutation can come out: rows are ranked by two
    independent hashes of their key, and the row at a rank of the first order
    takes the treatment of the row at that rank of the second. Ranges of a
    hash are ranked by themselves and ranks are joined by value, so no task
    holds the column; ``df`` is written once for this.

    With ``circle`` rows stand in a circle in the order of a hash of their
    key, and each takes the treatment of the row before it: every row gives
    its treatment to one other. One exchange is all; a range's first row takes
    the last of the range before it, from a table of one row a range.
    """
    if circle:
        both, new = _previous_in_circle(df, treatment_col, key, seed)
    else:
        rows = write_stage_table(df, "permuted")
        given = _hash_ranked(rows.select(key, F.col(treatment_col).alias("_w")), key, seed, "perm2", "_w", "_rank").select("_rank", "_w")
        both, new = _hash_ranked(rows, key, seed, "perm1", treatment_col, "_rank").join(given, "_rank"), F.col("_w")
    if out:
        return both.select(*df.columns, new.alias(out))
    return both.select(*[new.alias(c) if c == treatment_col else F.col(c) for c in df.columns])


def _previous_in_circle(df: DataFrame, treatment_col: str, key: str, seed: int) -> tuple[DataFrame, Column]:
    ranges = 4 * default_partitions(df)
    place = hash_uniform(key, seed, "perm1")
    rows = df.withColumns({"_u": place, "_range": F.floor(place * ranges).cast("int")})
    ends = rows.groupBy("_range").agg(F.max_by(treatment_col, F.struct("_u", key)).alias("_end"))
    by_range, whole = Window.orderBy("_range"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(by_range) == 1
    ends = ends.select("_range", F.when(first, F.last("_end").over(whole)).otherwise(F.lag("_end").over(by_range)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("_u", key)
    taken = rows.select("*", F.row_number().over(within).alias("_n"), F.lag(treatment_col).over(within).alias("_w"))
    return taken.join(F.broadcast(ends), "_range"), F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_w"))


def subset_condition(key: str = "customer_id", seed: int = 42, fraction: float = 0.8) -> Column:
    return hash_uniform(key, seed, "subset") < F.lit(fraction)


def subset_rows(df: DataFrame, key: str = "customer_id", seed: int = 42, fraction: float = 0.8) -> DataFrame:
    """About ``fraction`` of the rows by hash."""
    return df.where(subset_condition(key, seed, fraction))


def imbalance_warnings(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> list:
    """Warnings when treatment or outcome rate is below 5 % or above 95 %."""
    row = df.agg(F.avg(F.col(config.treatment).cast("double")).alias("t"),
                 F.avg(F.col(config.outcome).cast("double")).alias("y")).collect()[0]
    out = []
    for kind, rate in (("treatment", row["t"]), ("outcome", row["y"])):
        if rate is not None and (rate < 0.05 or rate > 0.95):
            out.append(f"{kind}: one class holds all but a few rows (share of ones {rate:.4f})")
    return out

