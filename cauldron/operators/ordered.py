"""Ordered computations: distributed prefix sums, global ranks, latest rows.

The reference computes running sums with a single-process cumsum over a
sorted frame (allocation, Qini curves, random targeting).  A Spark
``Window.orderBy`` without ``partitionBy`` would pull every row into one
task, so the kernel here splits the global order into contiguous buckets.
There is one plan, at every size:

1. a sample of the ordering key (primary key, tie key) gives bucket edges:
   rows are dealt by a hash of the tie and each group keeps the row of
   smallest hash, so one partial aggregation yields a bounded, deterministic
   sample without counting; the edges become one constant of the plan, so
   that every use of them sees the same ones;
2. each row's bucket is the number of edges at or before it, found by a
   binary search over the edge array in the JVM, in the key's own type;
3. per-bucket totals (one row per bucket) get exclusive running totals;
4. a window partitioned by bucket adds the row's running sum to its offset.

Edges only affect balance, never the result.  NULL and NaN keys come last in
either direction.  Ties on the primary key are split by the tie key (a unique
id), so a primary value held by a third of all rows is still spread over many
buckets.  Sums of money run in exact decimals, which makes the result
independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
BUCKETS_PER_PARTITION = 4
SAMPLES_PER_BUCKET = 16


def default_partitions(df: DataFrame) -> int:
    try:
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


def order_struct(df: DataFrame, key: str, tie: str, desc: bool) -> Column:
    """A struct whose ascending order is the order asked for; comparable in every step.

    Descending integers are complemented (exact over the whole range),
    descending fractions negated; strings can only ascend.
    """
    kind, c = df.schema[key].dataType, F.col(key)
    missing = c.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = F.bitwise_not(c.cast("bigint")) if desc else c.cast("bigint")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        value = -c if desc else c
    elif desc:
        raise ValueError(f"descending order on {kind.simpleString()} is not supported")
    else:
        value = c
    return F.struct(F.when(missing, 1).otherwise(0).alias("last"), F.when(~missing, value).alias("value"),
                    F.col(tie).cast("bigint").alias("tie"))


def _edges(df: DataFrame, order: Column, tie: str, buckets: int, seed: int) -> Column:
    """About ``buckets`` edges in order, as one constant array (folded once, sent with the tasks)."""
    spread = F.xxhash64(F.col(tie), F.lit(seed))
    sample = df.select(order.alias("o"), spread.alias("h")) \
        .groupBy(F.pmod("h", F.lit(buckets * SAMPLES_PER_BUCKET))).agg(F.min_by("o", "h").alias("o"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / buckets))
    thinned = sample.agg(F.array_sort(F.collect_list("o")).alias("s")).select(
        F.filter("s", lambda o, i: (i % step == 0) & (i > 0)).alias("edges"))
    text = thinned.select(F.to_json("edges")).first()[0]
    return F.from_json(F.lit(text), thinned.schema["edges"].dataType)


def _bucket(order: Column, edges: Column, buckets: int) -> Column:
    """Number of edges at or before ``order``: binary search in ceil(log2(buckets)) steps."""
    steps = F.sequence(F.lit(1), F.lit(max(1, buckets.bit_length())))

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(edges, mid)
        return F.when(s["lo"] >= s["hi"], s).when(
            at <= order, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def running_totals(
    df: DataFrame,
    key: str,
    tie: str,
    sums: dict[str, Column] | None = None,
    *,
    desc: bool = True,
    rank: str | None = "rank",
    buckets: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Add inclusive running sums (and a 1-based global rank) in (key, tie) order.

    ``key`` is any orderable column (descending only for numbers), ``tie`` a
    unique integer column breaking ties ascending.  NULL and NaN keys come
    last.  Every column of ``df`` is kept; ``sums`` maps output names to the
    column summed.
    """
    sums = dict(sums or {})
    buckets = max(1, buckets if buckets is not None else BUCKETS_PER_PARTITION * default_partitions(df))
    order = order_struct(df, key, tie, desc)
    # what is summed and ordered becomes a column once, so each use is the same value
    keyed = df.withColumns({"_order": order} | {f"_v_{name}": c for name, c in sums.items()})
    keyed = keyed.withColumn(BUCKET, _bucket(F.col("_order"), _edges(df, order, tie, buckets, seed), buckets))
    # per-bucket totals: partial aggregation map-side, so only B rows per task
    # cross the network for them; the rows themselves are shuffled once below
    totals = keyed.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("_t_n"),
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums],
    )
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``buckets`` rows: the only window without a partition
    offsets = totals.select(
        F.col(BUCKET).alias("_ob"),
        F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    within = Window.partitionBy(BUCKET).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.col(c) for c in df.columns]
    # a bucket without any value to sum so far has NULL totals
    run = {name: F.coalesce(F.sum(f"_v_{name}").over(within), F.lit(0)) for name in sums}
    ranked = keyed.select("*", *[c.alias(f"_w_{name}") for name, c in run.items()],
                          F.row_number().over(within).alias("_w_n"))
    y = ranked.join(F.broadcast(offsets), F.col(BUCKET) == F.col("_ob"), "left")
    for name in sums:
        out.append((F.col(f"_o_{name}") + F.col(f"_w_{name}")).alias(name))
    if rank:
        out.append((F.col("_o_n") + F.col("_w_n")).cast("bigint").alias(rank))
    return y.select(*out)


def global_rank(df: DataFrame, key: str, tie: str, *, desc: bool = True, rank: str = "rank",
                buckets: int | None = None) -> DataFrame:
    """1-based position in (key, tie) order without a single-task window."""
    return running_totals(df, key, tie, {}, desc=desc, rank=rank, buckets=buckets)


def exact_median(df: DataFrame, col: str, tie: str, *, alias: str | None = None) -> DataFrame:
    """Exact median (mean of the two middle values for an even count) as a one-row frame.

    The middle rows come from weighted selection with weight 1.  An empty
    input gives one row with NULL.
    """
    from .selection import ascending, weighted_cuts

    alias = alias or f"median_{col}"
    rows = df.select(col, tie).where(F.col(col).isNotNull())
    cuts, _ = weighted_cuts(rows, [ascending(F.col(col)), F.col(tie)], F.lit(1), lambda n, _: [(n + 1) // 2 - 1, (n + 2) // 2 - 1])
    middle = sum(c.key[0] for c in cuts) / 2 if all(cuts) else None
    return df.sparkSession.range(1).select(F.lit(middle).cast("double").alias(alias))


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Newest row per key by ``order_cols`` descending.

    One aggregation with ``max_by``: partial aggregation runs map-side, so a
    key holding a third of all rows costs one buffer per task, not a sort.
    """
    best = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(key).agg(best.alias("_latest")).select(key, *[F.col(f"_latest.{c}").alias(c) for c in value_cols])
