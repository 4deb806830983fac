"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "cauldron",
    shuffle_partitions: int = 8,
    driver_memory: str = "16g",
    extra: dict | None = None,
) -> SparkSession:
    """Session for tests, benches and local runs.

    On a cluster the master, memory and partition counts come from the
    launcher; this helper is for local mode.  The UI stays off.
    """
    builder = (
        SparkSession.builder.master(master or os.environ.get("CAULDRON_MASTER", "local[8]"))
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # traffic with Python workers without TCP's delayed acknowledgements
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.driver.memory", driver_memory)
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it into the context.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used when present.  Only a local-mode session without the setting
    (tests, benches) gets a fresh folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for checkpoints on a cluster"
        )
    local = tempfile.mkdtemp(prefix="cauldron-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors (once a context), as --py-files would; Python workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_cauldron_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cauldron-code-"), "cauldron_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._cauldron_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = ensure_checkpoint_dir(spark)
    import uuid

    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df, name: str = "stage"):
    """Eager reliable checkpoint into the shared checkpoint folder.

    Cuts the lineage (cheap planning for later stages) and, unlike a local
    checkpoint, survives the loss of the executors that computed it.  The
    plan is persisted for the duration of the checkpoint so it is computed
    once (an unpersisted checkpoint recomputes it for the file write).
    ``write_stage_table`` is the parquet alternative for tables that later
    reads should prune and filter.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def write_stage_table(df, name: str = "stage"):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_concurrently(tasks, max_workers: int = 4) -> list:
    """Run independent Spark actions (e.g. model fits) from a small thread pool.

    Each callable submits its own jobs; the scheduler interleaves them, which
    hides per-job latency when single fits cannot fill the cluster.  Results
    come back in task order; the first exception is re-raised.
    """
    from concurrent.futures import ThreadPoolExecutor

    tasks = list(tasks)
    if len(tasks) <= 1 or max_workers <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(tasks))) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]
