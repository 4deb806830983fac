"""Line numbers and JSON objects of files read in small splits."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cauldron.sources import io as sio
from cauldron.sources import located as lo


@pytest.fixture(params=["64", "1000", "128m"])
def split(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k in names:
        spark.conf.unset(k)


def test_line_numbers(spark, split):
    d = tempfile.mkdtemp()
    rng = random.Random(1)
    want = []
    for name in ("a.txt", "b.txt"):
        lines = ["".join(rng.choice("xyé ") for _ in range(rng.choice([0, 3, 40]))) for _ in range(60)]
        with open(f"{d}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
        want += [(name, i + 1, v) for i, v in enumerate(lines)]
    got = lo.numbered_lines(spark, d).select(F.element_at(F.split("file", "/"), -1), "line", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("wrapped", [False, True])
@pytest.mark.parametrize("indent", [None, 2])
def test_objects_of_one_large_array(spark, split, wrapped, indent):
    rng = random.Random(2)
    odd = ['}', '{', '"', '\\', '\\"}', 'a}{"b":1', "", "é}", "\n", ",]["]
    rows = [{"id": str(i), "s": "".join(rng.choice(odd) for _ in range(rng.randint(0, 4))),
             **({"more": {"deep": [{"x": rng.choice(odd)}, {}]}} if i % 5 == 0 else {})} for i in range(120)]
    d = tempfile.mkdtemp()
    for name, part in (("a.json", rows[:70]), ("b.json", rows[70:]), ("c.json", [])):
        with open(f"{d}/{name}", "w") as f:
            json.dump({"customers": part} if wrapped else part, f, indent=indent)
    got = [json.loads(r.text) for r in lo.array_objects(spark, d).collect()]
    key = lambda r: int(r["id"])
    assert sorted(got, key=key) == rows


def test_other_documents_are_left_to_the_whole_reader(spark):
    d = tempfile.mkdtemp()
    with open(f"{d}/a.json", "w") as f:
        json.dump({"about": {"x": 1}, "customers": [{"a": 1}]}, f)
    assert lo.array_objects(spark, d) is None


def test_a_large_array_takes_many_tasks(spark):
    d = tempfile.mkdtemp()
    with open(f"{d}/a.json", "w") as f:
        json.dump([{"customer_id": i, "age": 1} for i in range(2000)], f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert lo._records(spark, d, "}").select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert lo.array_objects(spark, d).count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
