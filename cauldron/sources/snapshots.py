"""Tables that change as a whole: folders written aside, made current by one small pointer file.

``root/_commits/<number>.json`` lists, for every part of a table (the whole, a
run, a hash bucket), the folder that holds it. A change computes and writes
new folders first and then adds the next pointer file; until it stands under
its name, readers see the old folders, whole. A step that fails earlier leaves
nothing but folders that no pointer names. Folders named by the last two
pointers stay, so a reader that began before a commit can end; older ones are
removed after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage_table

_POINTERS = "_commits"
KEPT_COMMITS = 2
BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/{_POINTERS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _pointer(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/{_POINTERS}/{number:012d}.json", wholetext=True).first()[0])


def current(spark: SparkSession, root: str) -> dict:
    """Part name -> folder below ``root``, of the newest commit; empty before the first."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    return _pointer(spark, root, numbers[-1]) if numbers else {}


def new_folder(part: str) -> str:
    """A folder for a new version of a part, not yet anybody's."""
    return f"{part}/commit={uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, changes: dict, seen: dict) -> None:
    """Make ``changes`` (part -> folder, None: no longer there) current on top of ``seen``, what the change was made from.

    Refused if another commit came in between: its folders would be lost.
    """
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    if (_pointer(spark, root, numbers[-1]) if numbers else {}) != seen:
        raise RuntimeError(f"{root} changed while this change was made")
    folders = {part: folder for part, folder in {**seen, **changes}.items() if folder}
    fs, aside = _fs(spark, f"{root}/{_POINTERS}/{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    number = numbers[-1] + 1 if numbers else 1
    _, place = _fs(spark, f"{root}/{_POINTERS}/{number:012d}.json")
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, False)
        raise RuntimeError(f"{root} changed while this change was made")
    _forget(spark, root, [*numbers, number])


def _forget(spark: SparkSession, root: str, numbers: list[int]) -> None:
    """Remove pointers before the kept ones and the folders that only they name."""
    old, kept = numbers[:-KEPT_COMMITS], numbers[-KEPT_COMMITS:]
    needed = {folder for n in kept for folder in _pointer(spark, root, n).values()}
    for n in old:
        for folder in set(_pointer(spark, root, n).values()) - needed:
            fs, p = _fs(spark, f"{root}/{folder}")
            fs.delete(p, True)
        fs, p = _fs(spark, f"{root}/{_POINTERS}/{n:012d}.json")
        fs.delete(p, False)


def read(spark: SparkSession, root: str, table: str, folders: dict | None = None) -> DataFrame | None:
    """The current parts below ``table``, with the partition columns in their names; None without any."""
    root = root.rstrip("/")
    folders = current(spark, root) if folders is None else folders
    mine = sorted(folder for part, folder in folders.items() if part == table or part.startswith(f"{table}/"))
    if not mine:
        return None
    return spark.read.option("basePath", f"{root}/{table}").parquet(*[f"{root}/{folder}" for folder in mine]).drop("commit")


def replace_table(df: DataFrame, root: str, table: str = "rows") -> None:
    """A table replaced as a whole (S6): readers have the old rows until the new ones stand."""
    spark, root = df.sparkSession, root.rstrip("/")
    seen, folder = current(spark, root), new_folder(table)
    df.write.parquet(f"{root}/{folder}")
    commit(spark, root, {table: folder}, seen)


def upsert_table(incoming: DataFrame, root: str, key: str = "customer_id", buckets: int = 64, seq_col: str | None = None) -> None:
    """Merge a batch into a table stored in hash buckets of its key (S5): only the batch's buckets are read and written.

    ``buckets`` counts for the first batch; later ones keep the table's number.
    """
    from .io import upsert

    spark, root = incoming.sparkSession, root.rstrip("/")
    seen = current(spark, root)
    buckets = next((int(part.rsplit("of=", 1)[1].split("/")[0]) for part in seen if "of=" in part), buckets)
    table = f"rows/of={buckets}"
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    batch = write_stage_table(incoming.withColumn(BUCKET, at), "batch")
    touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
    if not touched:
        return
    held = {part: folder for part, folder in seen.items() if part in {f"{table}/{BUCKET}={b}" for b in touched}}
    old = read(spark, root, "rows", held)
    merged = upsert(old.drop("of", BUCKET) if old is not None else None, batch.drop(BUCKET), key, seq_col)
    folder = new_folder(table)
    merged.withColumn(BUCKET, at).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    commit(spark, root, {f"{table}/{BUCKET}={b}": f"{folder}/{BUCKET}={b}" for b in touched}, seen)


def read_upserted(spark: SparkSession, root: str) -> DataFrame | None:
    rows = read(spark, root, "rows")
    return rows.drop("of", BUCKET) if rows is not None else None


def store_bucketed(df: DataFrame, name: str, path: str, key: str = "customer_id", buckets: int = 64) -> DataFrame:
    """``df`` as catalog table ``name`` in ``path``, hash-bucketed and sorted by ``key``: joins and groupings on the key
    read it without an exchange (J1, S9)."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
