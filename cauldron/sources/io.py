"""Sources and sinks.

Readers use explicit schemas (never inference); writers are Spark's
distributed writers.  Contract checks run as aggregates before anything is
written, and a failing check raises with the check name.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality as qa
from . import located, snapshots
from ..schema import CUSTOMER_SCHEMA, MODEL_INPUT_COLUMNS, OPTIONAL_COLUMNS, REQUIRED_COLUMNS
from ..session import write_stage_table

_CONTRACT = tuple(f.name for f in CUSTOMER_SCHEMA.fields)


def _cells(columns) -> tuple[list, Column]:
    """(the contract's cells from text columns, the names of those that are missing or can't be read as their type)."""
    cells, faults = [], []
    for f in CUSTOMER_SCHEMA.fields:
        text = F.trim(F.col(f"`{f.name}`")) if f.name in columns else F.lit(None).cast("string")
        cell = F.when(text == "", None).otherwise(text).try_cast(f.dataType)
        cells.append(cell.alias(f.name))
        unread = F.coalesce(text, F.lit("")) != ""
        faults.append(F.when(cell.isNull() & (unread | F.lit(f.name in REQUIRED_COLUMNS)), F.lit(f.name)))
    return cells, F.array_compact(F.array(*faults))


def _typed(raw: DataFrame, refuse: bool = True, locate=None) -> DataFrame:
    """Text cells cast to the contract types, columns found by name.

    ``refuse`` stops at a cell that is missing or can't be read as its type,
    naming the row and the columns, and with ``locate`` (a function that gives
    ``faulty_rows``) the file and line; without it such cells become NULL.
    """
    cells, faults = _cells(raw.columns)
    if refuse:
        key = F.col("customer_id") if "customer_id" in raw.columns else F.lit(None)
        _refuse(raw.select(key.alias("id"), faults.alias("columns")).where(F.size("columns") > 0).first(), locate)
    return raw.select(*cells)


def _refuse(hit, locate=None) -> None:
    """Raise for a row (id, columns) with faults; with ``locate`` for the first one by file and line."""
    if hit:
        at = locate().orderBy("file", "line").first() if locate else None
        place = f"{at.file}, line {at.line}: " if at else ""
        hit = (at.customer_id, at["columns"]) if at else (hit.id, hit["columns"])
        raise ValueError(f"{place}row of customer {hit[0]!r}: missing or unreadable {', '.join(hit[1])}")


def faulty_rows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(file, line, customer_id as text, columns) of rows with a cell that is missing or can't be read (V3).

    ``fmt``: csv with a header, which is line 1, or json (lines). Rows are
    lines, so a row without an id is found as well.
    """
    lines = located.numbered_lines(spark, path).where(F.trim("value") != "")
    if fmt == "csv":
        names = _by_header(spark, path).columns
        row = lines.where("line > 1").select("file", "line", F.from_csv("value", ", ".join(f"`{c}` string" for c in names)).alias("r"))
        flat = row.select("file", "line", *[F.col(f"r.`{c}`").alias(c) for c in names])
    else:
        row, names = lines.select("file", "line", F.from_json("value", "map<string,string>").alias("r")), list(_CONTRACT)
        flat = row.select("file", "line", *[F.col("r")[c].alias(c) for c in names])
    key = F.col("customer_id") if "customer_id" in names else F.lit(None).cast("string")
    return flat.select("file", "line", key.alias("customer_id"), _cells(names)[1].alias("columns")).where(F.size("columns") > 0)


def check_contract_columns(columns) -> None:
    """V1 + V2 on a header: all required present, nothing unknown."""
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    unknown = sorted(set(columns) - set(REQUIRED_COLUMNS) - set(OPTIONAL_COLUMNS))
    if missing or unknown:
        raise ValueError(f"columns of the input: absent {missing}, not in the contract {unknown}")


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV text cells under the names of the header; files whose header differs from the first are refused."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def scan_customers_csv(spark: SparkSession, path: str, refuse: bool = True) -> DataFrame:
    """CSV with a header (S1): columns by name, header checked, cells read as text, then typed."""
    raw = _by_header(spark, path)
    check_contract_columns(raw.columns)
    return _typed(raw, refuse, lambda: faulty_rows(spark, path, "csv"))


def scan_customers_json(spark: SparkSession, path: str, multiline: bool = True, refuse: bool = True) -> DataFrame:
    """Customers as JSON (S2): an array, an object with a ``customers`` array, or JSON lines (``multiline=False``).

    Rows are parsed as maps, so no schema is inferred and unknown keys are
    seen. A document that is an array, or begins with the ``customers`` array,
    is read in as many tasks as its size asks for; one of another form is one
    task. JSON lines always split. With ``refuse`` rows are parsed once, into
    a written table that the checks and the result read.
    """
    cell = "map<string,string>"
    objects = located.array_objects(spark, path, "customers") if multiline else None
    if objects is not None:
        maps = objects.select(F.from_json("text", cell).alias("m"))
    elif multiline:
        text = spark.read.option("wholetext", True).text(path)
        rows = F.coalesce(F.from_json("value", f"array<{cell}>"),
                          F.from_json("value", f"struct<customers:array<{cell}>>")["customers"])
        rows = F.when(F.ltrim("value").startswith("{"), F.from_json(
            "value", f"struct<customers:array<{cell}>>")["customers"]).otherwise(rows)
        shapeless = text.where(rows.isNull()).first()
        if shapeless:
            raise ValueError("a JSON document holds neither an array of rows nor one under 'customers'")
        maps = text.select(F.explode(rows).alias("m"))
    else:
        maps = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", cell).alias("m"))
    texts = [F.col("m")[c].alias(c) for c in _CONTRACT]
    if not refuse:
        return _typed(maps.select(*texts), False)
    unknown = F.array_except(F.map_keys("m"), F.array(*[F.lit(c) for c in _CONTRACT]))
    cells, faults = _cells(_CONTRACT)
    rows = maps.select(unknown.alias("_keys"), *texts).select(
        "_keys", F.col("customer_id").alias("_id"), faults.alias("_faults"), F.monotonically_increasing_id().alias("_at"), *cells)
    # filters on unwritten rows would parse a row again for every cell they look at
    rows = write_stage_table(rows, "customers-parsed")
    odd = rows.where("_keys IS NULL OR size(_keys) > 0").orderBy("_at").first()
    if odd:
        raise ValueError(f"row of customer {odd['_id']!r}: keys not in the contract {odd['_keys']}")
    faulty = rows.where("size(_faults) > 0").orderBy("_at").select(F.col("_id").alias("id"), F.col("_faults").alias("columns"))
    _refuse(faulty.first(), None if multiline else lambda: faulty_rows(spark, path, "json"))
    return rows.select(*_CONTRACT)


def scan_customers_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored customer table."""
    return spark.read.schema(CUSTOMER_SCHEMA).parquet(path)


def scan_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Predictions with the four required columns by name, numeric and finite (S3)."""
    schema = T._parse_datatype_string("customer_id bigint, baseline_probability double, treatment_probability double, ite double")
    df = _by_header(spark, path) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"predictions lack {absent}")
    df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    _raise_failed(qa.check_finite(df))
    return df


def _raise_failed(checks: DataFrame) -> None:
    bad = checks.where(~F.col("passed")).collect()
    if bad:
        raise ValueError("failed checks: " + ", ".join(f"{r['check']}({r['violations']})" for r in bad))


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str = "customer_id",
           seq_col: str | None = None) -> DataFrame:
    """Merge by key, last write wins on every column.

    One grouped ``max_by`` over the union: partial aggregation runs map-side,
    so duplicate keys inside one batch and across batches resolve by the
    sequence column (later wins) without a sort. Rows of one key and sequence
    resolve by their values, so the result never depends on partitioning.
    """
    cols = [c for c in incoming.columns if c != seq_col]
    new = incoming.withColumn("_seq", F.col(seq_col).cast("bigint") + 1 if seq_col else F.lit(1).cast("bigint"))
    if existing is not None:
        old = existing.select(*[F.col(c) if c in existing.columns else F.lit(None).cast(incoming.schema[c].dataType).alias(c)
                                for c in cols]).withColumn("_seq", F.lit(0).cast("bigint"))
        new = old.unionByName(new.select(*cols, "_seq"))
    row = F.struct(*[F.col(c) for c in cols])
    best = F.max_by(row, F.struct(F.col("_seq"), row))
    return new.groupBy(key).agg(best.alias("_r")).select("_r.*")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None, fmt: str = "parquet") -> None:
    """Distributed write; ``overwrite`` replaces."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def export_customers(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """All columns ordered by id (S7): a range-partitioned sort, one file per range."""
    out = df.orderBy("customer_id")
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").json(path)


def write_customer_documents(df: DataFrame, path: str, rows_per_document: int = 4096) -> None:
    """The wrapped JSON form (S2), a file for each document of about ``rows_per_document`` customers.

    Customers are dealt by a hash of their id, so the number of documents
    follows the row count, and no document grows with the table or with a
    frequent segment. ``df`` is read twice, for the count and for the rows.
    """
    n = max(1, -(-df.count() // rows_per_document))
    docs = df.groupBy(F.pmod(F.xxhash64("customer_id"), F.lit(n)).alias("document")) \
        .agg(F.collect_list(F.struct(*df.columns)).alias("customers"))
    docs.select(F.to_json(F.struct("customers")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def export_model_input(df: DataFrame) -> DataFrame:
    """The 15-column model input ordered by id, no ground truth."""
    return df.select(*MODEL_INPUT_COLUMNS).orderBy("customer_id")


def export_query(spark: SparkSession, sql: str, path: str, fmt: str = "csv", **frames) -> None:
    """Arbitrary SQL (DataFrames passed as named arguments) to CSV / JSON."""
    out = spark.sql(sql, **frames)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").json(path)


def write_predictions(predictions: DataFrame, customers: DataFrame, path: str, key: str = "customer_id") -> None:
    """Finite and coverage checks, then write."""
    _raise_failed(qa.check_finite(predictions))
    cov = qa.check_coverage(customers, predictions, key).collect()
    if cov:
        missing = [r[key] for r in cov if r["side"] == "missing"]
        extra = [r[key] for r in cov if r["side"] == "extra"]
        raise ValueError(f"predictions and customers differ: no prediction for {missing}, no customer for {extra}")
    predictions.write.mode("overwrite").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """The run records (name, budget, model_run_id) under ``root``; None before the first run."""
    return read_run_table(spark, root, "runs")


def read_run_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """``predictions``, ``recommendations`` or ``runs`` of all stored runs, as one commit has them; None without rows."""
    return snapshots.read(spark, root, table)


def import_run(predictions: DataFrame, customers: DataFrame, root: str, run_id: int, name: str, budget: float,
               replace: bool = False) -> None:
    """Store a run (S12): its record, its predictions and the greedy selection within ``budget``.

    ``customers`` has the money columns. Tables are partitioned by run. An id
    or a name that is already there is refused; with ``replace`` the runs of
    that name go. Everything is computed and written aside before one commit
    changes what readers see: a failure leaves the stored runs as they were.
    """
    from ..operators.allocate import allocate_greedy

    spark, root = predictions.sparkSession, root.rstrip("/")
    seen = snapshots.current(spark, root)
    runs = snapshots.read(spark, root, "runs", seen)
    known = {r.model_run_id: r.name for r in runs.collect()} if runs is not None else {}
    named = [i for i, n in known.items() if n == name]
    if (named and not replace) or (run_id in known and known[run_id] != name):
        raise ValueError(f"run {run_id} ({name!r}) is stored already")
    chosen = allocate_greedy(customers.join(predictions.select("customer_id", "ite"), "customer_id"), budget)
    chosen = chosen.where("selected = 1").select("customer_id", "ite", "expected_profit", "expected_cost")
    record = spark.createDataFrame([(name, float(budget))], "name string, budget double")
    tables = {"predictions": predictions, "recommendations": chosen, "runs": record}
    changes: dict = {f"{table}/model_run_id={old}": None for table in tables for old in named}
    for table, df in tables.items():
        part = f"{table}/model_run_id={run_id}"
        changes[part] = snapshots.new_folder(part)
        df.write.parquet(f"{root}/{changes[part]}")
    snapshots.commit(spark, root, changes, seen)


def _not_finite(kind: T.DataType, c: Column, path: Column) -> Column | None:
    """The place (as body[3].a) of the first NaN or infinity in a value, NULL without one; None if its type can't hold any."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), path)
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields
                 if (x := _not_finite(f.dataType, c.getField(f.name), F.concat(path, F.lit("." + f.name)))) is not None]
        return F.coalesce(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _not_finite(kind.elementType, F.lit(None).cast(kind.elementType), path) is None:
            return None
        places = F.transform(c, lambda x, i: _not_finite(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0))
    if isinstance(kind, T.MapType):
        if _not_finite(kind.valueType, F.lit(None).cast(kind.valueType), path) is None:
            return None
        places = F.transform(F.map_entries(c), lambda e: _not_finite(
            kind.valueType, e["value"], F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))))
        return F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0))
    return None


def _first_not_finite(df: DataFrame) -> Column | None:
    places = [x for f in df.schema.fields if (x := _not_finite(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))) is not None]
    return F.coalesce(*places) if places else None


_NOT_FINITE = "a report value is not finite: "


def _finite(df: DataFrame, key: str | None) -> DataFrame:
    """``df`` as it is; a row with a value that is not finite stops the job that reads it and names the place."""
    place = _first_not_finite(df)
    if place is None:
        return df
    owner = F.concat(F.lit(f" ({key} "), F.col(key).cast("string"), F.lit(")")) if key else F.lit("")
    return df.where(F.assert_true(place.isNull(), F.concat(F.lit(_NOT_FINITE), place, owner)).isNull())


def check_report_finite(df: DataFrame, key: str | None = None) -> None:
    """Refuse NaN or infinity anywhere in a report, nested values included, naming the place."""
    place = _first_not_finite(df)
    if place is None:
        return
    hit = df.select((F.col(key) if key else F.lit(None)).alias("k"), place.alias("at")).where(F.col("at").isNotNull()).first()
    if hit:
        raise ValueError(f"{_NOT_FINITE}{hit['at']}" + (f" ({key} {hit['k']})" if key else ""))


def write_report(df: DataFrame, path: str, key: str | None = None) -> None:
    """One JSON write that refuses values that are not finite (S13); nothing is stored then."""
    try:
        _finite(df, key).write.mode("overwrite").json(path)
    except Exception as failed:
        found = re.search(re.escape(_NOT_FINITE) + r"[^\n]*?(?= SQLSTATE|\n|$)", str(failed))
        if not found:
            raise
        raise ValueError(found[0].strip()) from failed


def update_run_metrics(runs: DataFrame, run_id: int, metrics: dict) -> DataFrame:
    """Merge metrics into the run record's ``metrics`` map, a metric named again with its new value."""
    if not metrics:
        return runs
    m = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), F.lit(float(v)))])
    old = F.coalesce(F.col("metrics"), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*metrics))
    return runs.withColumn("metrics", F.when(F.col("id") == run_id, F.map_concat(kept, m)).otherwise(F.col("metrics")))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive checksum, the sum of row hashes, in which repeated rows count."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def dataset_manifest(tables: dict) -> DataFrame:
    """(table, rows, checksum) for every named output table."""
    out = None
    for name, df in tables.items():
        row = table_fingerprint(df).select(F.lit(name).alias("table"), "rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


def stored_manifest(spark: SparkSession, folders: dict) -> DataFrame:
    """(table, files, bytes, sha256) of folders as they are stored.

    ``sha256`` is over the sorted lines "path size digest" of the folder's
    data files, so a changed, added, lost or renamed file shows. Files are
    read whole, one a row: they have to stay below Spark's binary-file limit.
    """
    out = None
    for name, folder in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        inside = F.substring_index(F.col("path"), folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
        line = files.select("length", F.concat_ws(" ", inside, F.col("length").cast("string"), F.sha2("content", 256)).alias("line"))
        row = line.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                       F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("sha256"))
        row = row.select(F.lit(name).alias("table"), "files", "bytes", "sha256")
        out = row if out is None else out.unionByName(row)
    return out


def save_model(fitted, path: str, spark: SparkSession | None = None) -> None:
    """Persist a fitted effect model: Spark ML parts with their writers, the
    rest (preprocessing state, coefficients, metadata) as one JSON record (S14)."""
    import numpy as np

    from ..operators import learners as ln

    spark = spark or SparkSession.getActiveSession()  # a worker thread has no active one
    parts = {}
    for name in ("mu0", "mu1", "tau0", "tau1", "prop", "outcome"):
        part = getattr(fitted, name, None)
        if isinstance(part, ln._Boosted):
            spark.createDataFrame([(json.dumps(part.model.as_dict()),)], "model string").coalesce(1) \
                 .write.mode("overwrite").text(f"{path}/{name}")
            parts[name] = {"boosted": True}
        elif part is not None:
            part.model.write().overwrite().save(f"{path}/{name}")
            parts[name] = {"tag": part.tag, "kind": part.kind, "cls": type(part.model).__module__ + "." + type(part.model).__name__}
    meta = {
        "model_type": fitted.model_type, "config": fitted.cfg.__dict__, "features": fitted.features.__dict__,
        "prep": {k: getattr(fitted.prep, k) for k in ("numeric", "categorical", "means", "stds", "categories")},
        "parts": parts,
        "theta": np.asarray(getattr(fitted, "theta", [])).tolist(),
        "het_names": getattr(fitted, "het_names", []),
        "nuisance_names": getattr(fitted, "nuisance_names", []),
        "metadata": fitted.metadata(),
    }
    spark.createDataFrame([(json.dumps(meta, default=list),)], "meta string").coalesce(1) \
         .write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Inverse of ``save_model``."""
    import importlib

    import numpy as np

    from ..operators import learners as ln
    from ..operators.boosting import BoostedTrees
    from ..operators.prep import PreprocessorModel
    from ..schema import FeatureConfig, ModelConfig

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    prep = PreprocessorModel(**meta["prep"], warnings=meta["metadata"]["warnings"])
    cfg = ModelConfig(**meta["config"])
    feats = FeatureConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["features"].items()})
    parts = {}
    for name, info in meta["parts"].items():
        if info.get("boosted"):
            model = BoostedTrees.from_dict(json.loads(spark.read.text(f"{path}/{name}").first()[0]))
            parts[name] = ln._Boosted(model, model.kind)
            continue
        mod, cls = info["cls"].rsplit(".", 1)
        model = getattr(importlib.import_module(mod), cls).load(f"{path}/{name}")
        parts[name] = ln._Fit(model, info["tag"], info["kind"])
    kind = meta["model_type"]
    if kind == "t_learner":
        fitted = ln.FittedTLearner(prep, cfg, feats, parts["mu0"], parts["mu1"])
    elif kind == "x_learner":
        fitted = ln.FittedXLearner(prep, cfg, feats, *[parts[n] for n in ("mu0", "mu1", "tau0", "tau1", "prop")])
    else:
        fitted = ln.FittedDML(prep, cfg, feats, meta["het_names"], np.array(meta["theta"]), parts["outcome"],
                              meta["nuisance_names"])
    fitted.trained_at = meta["metadata"]["trained_at"]
    return fitted
