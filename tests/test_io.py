"""Sources and sinks: contract checks, upsert semantics, report guard, model round trip."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cauldron.schema import CUSTOMER_SCHEMA, REQUIRED_COLUMNS, ModelConfig
from cauldron.sources import derived
from cauldron.sources import io as sio

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def customers(spark):
    return derived.customers(spark, SF_SMALL).checkpoint(eager=True)


def _rows(df, n=3):
    return [r.asDict() for r in df.orderBy("customer_id").limit(n).collect()]


def test_json_wrapped_and_plain(spark, customers):
    rows = _rows(customers)
    d = tempfile.mkdtemp()
    for name, payload in (("plain.json", rows), ("wrapped.json", {"customers": rows})):
        with open(os.path.join(d, name), "w") as f:
            json.dump(payload, f)
        back = sio.scan_customers_json(spark, os.path.join(d, name))
        assert back.count() == 3
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in CUSTOMER_SCHEMA]
    with open(os.path.join(d, "bad.json"), "w") as f:
        json.dump({"rows": rows}, f)
    with pytest.raises(ValueError):
        sio.scan_customers_json(spark, os.path.join(d, "bad.json"))


def test_documents_stay_bounded(spark, customers):
    """One segment and campaign for all rows: the documents follow the row count all the same."""
    hot = customers.withColumn("customer_segment", F.lit("vip")).withColumn("campaign_id", F.lit(1))
    d = tempfile.mkdtemp()
    sio.write_customer_documents(hot, f"{d}/docs", rows_per_document=20)
    rows = spark.read.option("wholetext", True).text(f"{d}/docs").select(
        F.size(F.from_json("value", "struct<customers:array<map<string,string>>>")["customers"]).alias("n")).collect()
    assert sum(r.n for r in rows) == hot.count() and max(r.n for r in rows) <= 3 * 20
    back = sio.scan_customers_json(spark, f"{d}/docs")
    assert back.exceptAll(hot).count() == 0 and back.count() == hot.count()


def test_document_query_is_not_grouped_by_segment(spark, monkeypatch):
    from cauldron.plans import catalog_io

    whole, sizes = sio.scan_customers_json, []
    monkeypatch.setattr(sio, "write_customer_documents", lambda df, path, write=sio.write_customer_documents:
                        write(df, path, rows_per_document=20))
    monkeypatch.setattr(sio, "scan_customers_json", lambda s, path: sizes.append(
        s.read.option("wholetext", True).text(path).count()) or whole(s, path))
    n = catalog_io.q_scan_customers_document(spark, SF_SMALL).count()
    assert n / 20 - 5 <= sizes[0] <= n / 20 + 1


@pytest.mark.parametrize("wrapped", [True, False])
def test_json_rows_are_parsed_once(spark, customers, monkeypatch, wrapped):
    """Neither the checks nor the result parse a row again."""
    d, written = tempfile.mkdtemp(), []
    if wrapped:
        sio.write_customer_documents(customers, f"{d}/in", rows_per_document=20)
    else:
        sio.export_customers(customers, f"{d}/in", "json")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sio, "write_stage_table", lambda df, name, write=sio.write_stage_table: written.append(plan(df)) or write(df, name))
    back = sio.scan_customers_json(spark, f"{d}/in", multiline=wrapped)
    # objects of a document that are one fragment and those put together are two branches
    assert [p.count("from_json(") for p in written] == [2 if wrapped else 1] and "from_json(" not in plan(back)
    assert sorted(back.collect()) == sorted(customers.collect())


def test_the_first_faulty_json_row_is_named(spark, customers):
    d = tempfile.mkdtemp()
    row = json.loads(customers.limit(1).toJSON().first())
    with open(f"{d}/c.json", "w") as f:
        json.dump([row | {"customer_id": 10 * i} | ({"age": "old"} if i in (3, 5) else {}) | ({"extra": 1} if i == 7 else {}) for i in range(9)], f)
    with pytest.raises(ValueError, match="customer '70': keys not in the contract .'extra'"):
        sio.scan_customers_json(spark, f"{d}/c.json")
    with open(f"{d}/d.json", "w") as f:
        json.dump([row | {"customer_id": 10 * i} | ({"age": "old"} if i in (3, 5) else {}) for i in range(9)], f)
    with pytest.raises(ValueError, match="customer '30': missing or unreadable age"):
        sio.scan_customers_json(spark, f"{d}/d.json")
    assert sio.scan_customers_json(spark, f"{d}/d.json", refuse=False).where("age IS NULL").count() == 2


def test_csv_unknown_and_missing_columns(spark, customers):
    d = tempfile.mkdtemp()
    customers.withColumn("extra", F.lit(1)).limit(2).write.option("header", True).csv(f"{d}/extra")
    with pytest.raises(ValueError, match="not in the contract .'extra'"):
        sio.scan_customers_csv(spark, f"{d}/extra")
    customers.drop("age").limit(2).write.option("header", True).csv(f"{d}/missing")
    with pytest.raises(ValueError, match="absent .'age'"):
        sio.scan_customers_csv(spark, f"{d}/missing")


def test_empty_cells_are_missing(spark, customers):
    d = tempfile.mkdtemp()
    customers.limit(4).withColumn("customer_segment", F.when(F.col("customer_id") % 2 == 0, F.lit("")).otherwise(
        F.col("customer_segment"))).write.option("header", True).csv(f"{d}/c")
    with pytest.raises(ValueError, match="customer_segment"):
        sio.scan_customers_csv(spark, f"{d}/c")
    back = sio.scan_customers_csv(spark, f"{d}/c", refuse=False)
    from cauldron.operators.quality import rows_missing

    missing = rows_missing(back).collect()
    assert missing and all(r.missing == ["customer_segment"] for r in missing)


def test_refusals_name_file_and_line(spark, customers):
    d = tempfile.mkdtemp()
    rows = customers.orderBy("customer_id").limit(6).collect()
    cells = lambda r: ["" if v is None else str(v) for v in r]
    text = [cells(r) for r in rows]
    names = customers.columns
    text[1][names.index("customer_id")] = ""  # a row that has no id
    text[4][names.index("age")] = "old"
    with open(f"{d}/c.csv", "w") as f:
        f.write("\n".join(",".join(t) for t in [names, text[0], [""], *text[1:]]) + "\n")
    with pytest.raises(ValueError, match=r"c.csv, line 4: row of customer None: missing or unreadable customer_id"):
        sio.scan_customers_csv(spark, f"{d}/c.csv")
    found = sorted((r.line, r.customer_id, r["columns"]) for r in sio.faulty_rows(spark, f"{d}/c.csv").collect())
    assert found == [(4, None, ["customer_id"]), (7, str(rows[4].customer_id), ["age"])]
    with open(f"{d}/c.json", "w") as f:
        for r in rows:
            f.write(json.dumps({**r.asDict(), **({"age": None} if r == rows[3] else {})}) + "\n")
    with pytest.raises(ValueError, match=rf"c.json, line 4: row of customer '{rows[3].customer_id}': missing or unreadable age"):
        sio.scan_customers_json(spark, f"{d}/c.json", multiline=False)


def test_upsert_last_write_wins_and_nulls_reset(spark, customers):
    first = customers.limit(5)
    changed = first.limit(2).withColumn("campaign_id", F.lit(None).cast("int")).withColumn("age", F.lit(99))
    merged = sio.upsert(first, changed)
    assert merged.count() == 5
    hit = merged.where(F.col("age") == 99).collect()
    assert len(hit) == 2 and all(r.campaign_id is None for r in hit)
    # duplicates inside one batch: the later sequence wins
    dup = changed.withColumn("seq", F.lit(1)).unionByName(changed.withColumn("age", F.lit(7)).withColumn("seq", F.lit(2)))
    out = sio.upsert(first, dup, seq_col="seq")
    assert sorted(r.age for r in out.where(F.col("age").isin(7, 99)).collect()) == [7, 7]


def test_csv_columns_are_found_by_name(spark, customers):
    d = tempfile.mkdtemp()
    turned = customers.select(*reversed(customers.columns))
    turned.write.option("header", True).csv(f"{d}/turned")
    assert sorted(sio.scan_customers_csv(spark, f"{d}/turned").collect()) == sorted(customers.collect())
    customers.limit(2).coalesce(1).write.mode("append").option("header", True).csv(f"{d}/turned")
    with pytest.raises(Exception):  # files whose headers differ
        sio.scan_customers_csv(spark, f"{d}/turned", refuse=False).collect()
    spark.createDataFrame([(1, 0.3, 0.5, 0.2)], "customer_id long, ite double, baseline_probability double, "
                          "treatment_probability double").write.option("header", True).csv(f"{d}/p")
    assert sio.scan_predictions(spark, f"{d}/p", "csv").first().asDict() == {
        "customer_id": 1, "ite": 0.3, "baseline_probability": 0.5, "treatment_probability": 0.2}


def test_unreadable_cells_and_unknown_keys_are_refused(spark, customers):
    d = tempfile.mkdtemp()
    rows = _rows(customers, 2)
    for name, change in (("type", {"age": "old"}), ("key", {"colour": 1}), ("cell", {"purchase": None})):
        with open(f"{d}/{name}.json", "w") as f:
            json.dump([rows[0], {**rows[1], **change}], f)
        with pytest.raises(ValueError, match=f"'{rows[1]['customer_id']}'.*({'|'.join(change)})"):
            sio.scan_customers_json(spark, f"{d}/{name}.json")
    assert sio.scan_customers_json(spark, f"{d}/type.json", refuse=False).where("age IS NULL").count() == 1


def test_upsert_does_not_depend_on_partitioning(spark):
    rows = [(1, i % 8) for i in range(64)]
    got = {sio.upsert(None, spark.createDataFrame(rows, "customer_id long, v long").repartition(n)).first().v
           for n in (1, 3, 8)}
    assert got == {7}


def test_runs_are_kept_refused_and_replaced(spark):
    root = tempfile.mkdtemp() + "/runs"
    p = spark.range(10).selectExpr("id AS customer_id", "CAST(0.2 AS DOUBLE) AS baseline_probability",
                                   "CAST(0.4 AS DOUBLE) AS treatment_probability", "CAST(0.2 AS DOUBLE) AS ite")
    money = spark.range(10).selectExpr("id AS customer_id", "CAST(1 AS DOUBLE) AS discount_cost", "CAST(9 AS DOUBLE) AS net_revenue")
    sio.import_run(p, money, root, 1, "a", 4.0)
    sio.import_run(p.limit(5), money, root, 2, "b", 4.0)
    for run_id, name in ((1, "a"), (1, "other"), (3, "b")):
        with pytest.raises(ValueError):
            sio.import_run(p, money, root, run_id, name, 1.0)

    def stored(table):
        return {r.model_run_id: r["count"] for r in sio.read_run_table(spark, root, table).groupBy("model_run_id").count().collect()}

    assert stored("predictions") == {1: 10, 2: 5} and stored("recommendations") == {1: 4, 2: 4}
    sio.import_run(p.limit(2), money, root, 2, "b", 0.0, replace=True)  # an empty selection clears the old one
    assert stored("predictions") == {1: 10, 2: 2} and stored("recommendations") == {1: 4}
    sio.import_run(p, money, root, 7, "a", 2.0, replace=True)  # by name: the old id goes
    assert stored("predictions") == {2: 2, 7: 10} and stored("runs") == {2: 1, 7: 1}


def test_fingerprint_counts_repeated_rows(spark):
    rows = [(i, "x") for i in range(5)]
    twice = spark.createDataFrame(rows + rows, "a long, b string")
    other = spark.createDataFrame([(i + 9, "y") for i in range(5)] * 2, "a long, b string")
    a, b, c = (sio.table_fingerprint(t).first() for t in (twice, other, twice.repartition(4)))
    assert a != b and a == c and a.checksum != "0"


def test_write_report_refuses_non_finite(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "customer_id long, roi double")
    with pytest.raises(ValueError, match="roi .customer_id 2"):
        sio.write_report(df, tempfile.mkdtemp() + "/r", key="customer_id")
    deep = spark.range(1).select(F.struct(F.array(F.struct(F.lit(float("inf")).alias("x"))).alias("rows")).alias("doc"))
    for refuse in (sio.check_report_finite, lambda d: sio.write_report(d, tempfile.mkdtemp() + "/r")):
        with pytest.raises(ValueError, match=r"finite: doc.rows\[0\].x$"):
            refuse(deep)
    places = spark.createDataFrame([({"k": [{"a": [1.0, float("nan")]}]},)], "body map<string,array<struct<a:array<double>>>>")
    with pytest.raises(ValueError, match=r"body\[k\]\[0\].a\[1\]"):
        sio.check_report_finite(places)
    sio.check_report_finite(spark.range(1).select(F.struct(F.array(F.struct(F.lit(1.0).alias("x"))).alias("rows")).alias("doc")))


def test_metrics_merge_again_and_again(spark):
    runs = spark.createDataFrame([(1, {"mae": 1.0}), (2, None)], "id int, metrics map<string,double>")
    once = sio.update_run_metrics(runs, 1, {"mae": 2.0, "rmse": 3.0})
    twice = sio.update_run_metrics(sio.update_run_metrics(once, 1, {"rmse": 4.0, "auuc": 5.0}), 2, {"mae": 6.0})
    assert {r.id: r.metrics for r in sio.update_run_metrics(twice, 2, {}).collect()} == {
        1: {"mae": 2.0, "rmse": 4.0, "auuc": 5.0}, 2: {"mae": 6.0}}


def test_pipeline_keeps_earlier_runs_and_refuses_repeated_ids(spark, customers):
    from cauldron.plans.pipeline import run_pipeline

    out, cfg = tempfile.mkdtemp() + "/out", ModelConfig(model_type="t_learner", base_learner="linear")
    for run in (1, 2):
        run_pipeline(customers, cfg, run_id=run, refute=False, out_dir=out)
    predictions = spark.read.parquet(f"{out}/predictions")
    assert predictions.groupBy("model_run_id").count().where(f"count = {customers.count()}").count() == 2
    record = json.loads(spark.read.json(f"{out}/run_records/model_run_id=2").first().metadata)
    assert record["trained_at"] and isinstance(record["warnings"], list)
    manifest = {r["table"]: r for r in spark.read.json(f"{out}/manifest/model_run_id=2").collect()}
    folder = f"{out}/predictions/model_run_id=2"
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")]
    assert manifest["predictions"].files == len(files) and manifest["predictions"].bytes == sum(map(os.path.getsize, files))
    again = sio.stored_manifest(spark, {"predictions": folder}).first()
    assert again.sha256 == manifest["predictions"].sha256
    with open(files[0], "r+b") as f:  # one changed byte is found
        byte = f.read(1)
        f.seek(0)
        f.write(bytes([byte[0] ^ 1]))
    for crc in os.listdir(folder):
        if crc.endswith(".crc"):
            os.remove(f"{folder}/{crc}")
    assert sio.stored_manifest(spark, {"predictions": folder}).first().sha256 != again.sha256
    assert sio.load_model(spark, f"{out}/models/model_run_id=2").metadata()["trained_at"] == record["trained_at"]
    with pytest.raises(ValueError, match="stored already"):
        run_pipeline(customers, cfg, run_id=2, refute=False, out_dir=out)
    with pytest.raises(ValueError, match="repeat an id"):
        run_pipeline(customers.unionByName(customers.limit(3)), cfg, run_id=3, refute=False)


def test_imbalance_is_kept_with_the_model(spark, customers):
    from cauldron.operators.learners import CausalModel

    rare = customers.withColumn("purchase", F.when(F.col("customer_id") % 50 == 1, 1).otherwise(0))
    fitted = CausalModel(ModelConfig(model_type="t_learner", base_learner="linear")).fit(rare)
    assert len(fitted.metadata()["warnings"]) == 1


@pytest.mark.parametrize("base", ["linear", "lightgbm"])
def test_model_round_trip(spark, customers, base):
    from cauldron.operators.learners import CausalModel

    fitted = CausalModel(ModelConfig(model_type="dml", base_learner=base, n_estimators=5)).fit(customers)
    path = tempfile.mkdtemp() + "/m"
    sio.save_model(fitted, path)
    loaded = sio.load_model(spark, path)
    a = fitted.transform(customers).select("customer_id", "ite", "baseline_probability").orderBy("customer_id").collect()
    b = loaded.transform(customers).select("customer_id", "ite", "baseline_probability").orderBy("customer_id").collect()
    flat = lambda rows: [v for r in rows for v in r]
    assert flat(a) == pytest.approx(flat(b))


def test_required_columns_fixed():
    assert len(REQUIRED_COLUMNS) == 22 and REQUIRED_COLUMNS[0] == "customer_id"
