"""Streaming upsert of customer files and streaming scoring.

The reference loads customers in fixed-size batches with an idempotent
upsert. Here arriving files are a file stream, and the table is a log of
versions: every micro-batch appends its valid rows with their place in the
stream (batch, file time, file, row), rows with a missing required cell go to
a quarantine folder as they are, and a read keeps each customer's newest
version. So a batch costs what it brings, whatever the table's size; a
replayed batch overwrites its own folder. ``compact`` writes the newest
versions as a table of their own when the log has grown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.allocate import uplift_segments
from ..schema import CUSTOMER_SCHEMA, REQUIRED_COLUMNS
from ..sources.io import exists

VERSION = "_version"
_VERSION_TYPE = T.StructType([T.StructField("batch", T.LongType()), T.StructField("time", T.TimestampType()),
                              T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
_COLUMNS = [f.name for f in CUSTOMER_SCHEMA.fields]


def is_complete(required=REQUIRED_COLUMNS) -> Column:
    """Whether a row has every required cell; never NULL, so it and its negation part a batch in two."""
    cells = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required]
    return F.coalesce(reduce(lambda a, b: a & b, cells), F.lit(False))


def write_batch(batch: DataFrame, batch_id: int, table_root: str, quarantine_root: str) -> None:
    """One micro-batch (CUSTOMER_SCHEMA and the version's time, file and row): valid rows and the others, whole."""
    rows = batch.select(*_COLUMNS, F.struct(
        F.lit(batch_id).cast("bigint").alias("batch"), F.col("_time").alias("time"), F.col("_file").alias("file"),
        F.col("_row").alias("row")).alias(VERSION), is_complete().alias("_ok"))
    rows = rows.persist()  # two writes of one small batch
    try:
        for ok, root in ((True, table_root), (False, quarantine_root)):
            rows.where(F.col("_ok") == ok).drop("_ok").write.mode("overwrite").parquet(
                f"{root.rstrip('/')}/batch={batch_id}")
    finally:
        rows.unpersist()


def stream_upsert_customers(spark: SparkSession, source_dir: str, table_root: str, quarantine_root: str,
                            checkpoint: str, fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Start the file stream (T1); returns the StreamingQuery (trigger: available now)."""
    reader = spark.readStream.schema(CUSTOMER_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.lit(None)
    stream = reader.load(source_dir).select(
        *_COLUMNS, F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"),
        row.cast("bigint").alias("_row"))
    return (stream.writeStream
            .foreachBatch(lambda df, bid: write_batch(df, bid, table_root, quarantine_root))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def _versions(spark: SparkSession, table_root: str) -> DataFrame:
    if not exists(spark, table_root):
        raise FileNotFoundError(table_root)
    schema = T.StructType([*CUSTOMER_SCHEMA.fields, T.StructField(VERSION, _VERSION_TYPE)])
    return spark.read.schema(schema).parquet(table_root).select(*_COLUMNS, VERSION)


def _newest(versions: DataFrame, key: str) -> DataFrame:
    # versions that agree in everything (formats without row numbers) resolve by their values
    row = F.struct(VERSION, *_COLUMNS)
    return versions.groupBy(key).agg(F.max_by(row, row).alias("_r")).select("_r.*")


def read_current(spark: SparkSession, table_root: str, key: str = "customer_id") -> DataFrame:
    """The newest version of every customer: one aggregation, partial on the map side."""
    return _newest(_versions(spark, table_root), key).select(*_COLUMNS)


def compact(spark: SparkSession, table_root: str, out_root: str, key: str = "customer_id") -> None:
    """Write the newest versions, with their place in the stream, as the log that ``out_root`` begins with."""
    _newest(_versions(spark, table_root), key).select(*_COLUMNS, VERSION).write.mode("overwrite").parquet(
        f"{out_root.rstrip('/')}/batch=-1")


def score_stream(stream: DataFrame, score, baseline_threshold: float = 0.25) -> DataFrame:
    """Stateless scoring of arriving customers plus their uplift segment.

    ``score`` maps a DataFrame to one with baseline_probability,
    treatment_probability and ite (a fitted model's ``transform`` or the
    surrogate); it is applied per micro-batch by Spark.
    """
    return uplift_segments(score(stream), baseline_threshold=baseline_threshold)


def run_score_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, score,
                     schema=CUSTOMER_SCHEMA, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
    """Score every file in ``source_dir`` with an available-now trigger into parquet."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (score_stream(reader.load(source_dir), score).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
