import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradewell.sources import io, json_arrays, schemas

KEYS = "a string, b struct<c:array<string>,d:struct<e:string>>, n long"


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that one file is read by many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def made(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "日", "x", " ", "\\u007d", "a}b"]) for _ in range(rng.randint(0, 12)))
    return [
        {"a": rng.choice([None, text()]), "b": rng.choice([None, {"c": [text() for _ in range(rng.randint(0, 3))], "d": rng.choice([None, {"e": text()}])}]), "n": i}
        for i in range(n)
    ]


def as_json(row):
    return json.loads(json.dumps(row.asDict(recursive=True)))


@pytest.mark.parametrize("style", ["pretty", "one line", "spaced", "ascii"])
def test_every_object_of_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges, style):
    rows = made(7, 400)
    text = {
        "pretty": json.dumps(rows, indent=2, ensure_ascii=False),
        "one line": json.dumps(rows, separators=(",", ":"), ensure_ascii=False),
        "spaced": "﻿ \n " + json.dumps(rows, indent=1, ensure_ascii=False).replace("\n", "\r\n") + "\n\n",
        "ascii": json.dumps(rows),
    }[style]
    path = tmp_path / "rows.json"
    path.write_text(text, encoding="utf-8", newline="")
    schema = spark.createDataFrame([], KEYS).schema
    found = json_arrays.read_json_array(spark, str(path), schema, keep_corrupt=True)
    got = sorted(map(as_json, found.collect()), key=lambda r: r["n"])
    assert all(r.pop(io.CORRUPT) is None for r in got)
    assert got == rows
    assert spark.read.text(str(path), lineSep="}").select(F.spark_partition_id()).distinct().count() > 10
    whole = io.read_raw_json(spark, str(path), schema).collect()
    assert sorted(map(as_json, whole), key=lambda r: r["n"]) == got


def test_a_file_cut_off_loses_its_last_object_only(spark, tmp_path, small_ranges):
    rows = made(3, 50)
    text = json.dumps(rows, separators=(",", ":"))
    schema = spark.createDataFrame([], KEYS).schema
    last = text.rindex('{"a"')
    for name, cut in (("key", last + 3), ("value", len(text) - 3), ("between", last), ("closed", text.rindex('{"a"', 0, last) - 1)):
        path = tmp_path / f"{name}.json"
        path.write_text(text[:cut], encoding="utf-8")
        good, bad = io.split_corrupt(json_arrays.read_json_array(spark, str(path), schema, keep_corrupt=True))
        whole = {"key": 49, "value": 49, "between": 49, "closed": 48}[name]
        assert sorted(r.n for r in good.collect()) == list(range(whole)), name
        torn = [r[io.CORRUPT] for r in bad.collect()]
        assert len(torn) == (name in ("key", "value")), (name, torn)


def test_empty_files_and_arrays_and_bad_objects(spark, tmp_path):
    for name, text in (("a", ""), ("b", "[]"), ("c", " [ \n ] \n"), ("d", '[{"product_id": "1"}, {"product_id": 2,, }, {"product_id": "3"}]')):
        (tmp_path / f"{name}.json").write_text(text)
    found = json_arrays.read_json_array(spark, str(tmp_path), schemas.PRODUCTS, keep_corrupt=True)
    good, bad = io.split_corrupt(found)
    assert sorted(r.product_id for r in good.collect()) == ["1", "3"] and bad.count() == 1
    assert json_arrays.read_json_array(spark, str(tmp_path), schemas.PRODUCTS).count() == 3


def test_written_arrays_are_valid(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit('"}{'), F.col("id").cast("string")).alias("t")).repartition(4)
    json_arrays.write_json_arrays(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part=*/*.txt"))
    held = [r for f in files for r in json.loads(f.read_text())]
    assert len(files) == 4 and sorted(r["id"] for r in held) == list(range(1000))
    back = json_arrays.read_json_array(spark, str(tmp_path / "out"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_only_sums_of_ranges_leave_their_range(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    plan = plan_of(json_arrays.array_records(spark, str(tmp_path / "a.json")))
    assert "Python" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_a_file_is_read_three_times_and_an_object_parsed_once(spark, tmp_path, small_ranges):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(made(5, 200)), encoding="utf-8")
    schema = spark.createDataFrame([], KEYS).schema
    good, _ = io.split_corrupt(json_arrays.read_json_array(spark, str(path), schema, keep_corrupt=True))
    found = good.select("a", "b.c", F.size("b.c"), "n")
    assert len(found.collect()) == 200
    plan = plan_of(found).split("+- == Initial Plan ==")[0]
    print(plan)
    # Quotes of the ranges, the shuffle by range (used again for the depths), pieces at the borders.
    assert plan.count("FileScan text") <= 3
    assert plan.count("from_json(") == plan.count("Generate ")


def test_an_object_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = [{"a": "x" * 3000 + '"}{[' * 40, "b": {"c": ["}"] * 500, "d": None}, "n": i} for i in range(5)]
    rows[2] = {"a": None, "b": None, "n": 2}
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows), encoding="utf-8")
    schema = spark.createDataFrame([], KEYS).schema
    found = json_arrays.read_json_array(spark, str(tmp_path), schema)
    assert sorted(map(as_json, found.collect()), key=lambda r: r["n"]) == [r for r in rows for _ in range(2)]


@pytest.mark.parametrize("most", [None, 1, 4000])
def test_compressed_arrays_of_bounded_size(spark, tmp_path, most):
    """Rows stay in their partition; files are arrays by themselves and give the same rows when read."""
    rows = made(11, 300)
    df = spark.createDataFrame(rows, KEYS).repartition(3).cache()
    json_arrays.write_json_arrays(df, str(tmp_path / "out"), "gzip", most)
    files = list((tmp_path / "out").glob("part=*/*.txt.gz"))
    held = [json.loads(gzip.decompress(f.read_bytes())) for f in files]
    assert sorted(r["n"] for a in held for r in a) == list(range(300))
    assert len(files) == {None: 3, 1: 300}.get(most, len(files)) and all(held)
    assert most != 4000 or (3 < len(files) < 60)
    found = json_arrays.read_json_array(spark, str(tmp_path / "out"), df.schema, keep_corrupt=True)
    got = sorted(map(as_json, found.collect()), key=lambda r: r["n"])
    assert all(r.pop(io.CORRUPT) is None for r in got) and got == rows
    # A compressed file of as many bytes as its text is none that a } ends.
    for cut, bad in ((0, 0), (-3, 1)):
        text = json.dumps([{"n": i, "a": "x" * 50} for i in range(4)])
        (tmp_path / f"one{cut}.json.gz").write_bytes(gzip.compress(text[: len(text) + cut].encode()))
        good, torn = io.split_corrupt(json_arrays.read_json_array(spark, str(tmp_path / f"one{cut}.json.gz"), df.schema, keep_corrupt=True))
        assert [r.n for r in good.orderBy("n").collect()] == list(range(4 - bad)) and torn.count() == bad
